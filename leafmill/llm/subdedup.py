"""Substring dedup: repeated paragraphs by MinHash banding.

A paragraph is a line of at least ``MIN_WORDS`` words, or a run of shorter lines, up to a blank or a long one, that has
as many together.  Equal paragraphs collapse by hash first.  Each distinct one gets a MinHash of its word shingles, cut into
bands that are tuned for high recall at the wanted similarity.  Tables hold keys, places and bands only; texts are cut
again for those keys that share a bucket with another.

Members of a bucket are linked in rounds.  In each, some of its members become hubs, and every member of another component that
may meet the similarity by two exact bounds (sizes, and a bitmap of shingle parities: sets differ by at least the bits in which
their bitmaps do) is verified against them by exact Jaccard similarity; then the hubs leave the bucket.  Hubs are
taken only from members for which a semi-join still finds such a partner, and the rounds end when it finds none: no pair of
a bucket that meets the similarity is lost from the components, while a crowd of near copies makes a few rows a member and
not its pairs.  Each component keeps its first occurrence.

A passage is a run of words that stands elsewhere word by word, wherever lines break: inside longer lines, or over several short
ones.  Every ``MIN_WORDS`` words of a text have a rolling hash, and of each ``PASSAGE - MIN_WORDS + 1`` such hashes in
a row the smallest is an anchor (winnowing).  Equal runs of ``PASSAGE`` words hold the same anchor, so none is missed, and
what shares an anchor shares ``MIN_WORDS`` words at least.  The first place of each anchor stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded, byte_texts
from leafmill.llm._components import components
from leafmill.llm._store import discard, stored

MIN_WORDS = 30
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Runs of so many equal words are always found, whatever lines they stand in.
PASSAGE = 51
#: Words of 64 bits of a paragraph's bitmap.
MAP = 8
_SLICE = 1 << 16


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, far: float = 0.3, most: float = 0.2) -> tuple[int, int]:
    """(bands, rows): the fewest bands that collide at ``similarity`` with probability ``recall``, and at ``far`` with at most ``most``."""
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - far**rows) ** bands <= most:
            return bands, rows
    raise ValueError("no banding tells these similarities apart")


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Shingles of words; of fewer, the whole sequence."""
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))] or [b" ".join(words)] * bool(words)


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of the shingle sets of two paragraphs, A-Z lower-cased."""
    x, y = set(shingles(a.lower().split())), set(shingles(b.lower().split()))
    return len(x & y) / max(1, len(x | y))


def cut(text: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(first line, start, end, words with A-Z lower-cased) of each paragraph of a text, places in code points."""
    ascii_ = text.isascii()
    run: list[bytes] = []
    first = start = end = at = 0
    for number, line in enumerate(text.split(b"\n")):
        chars = len(line) if ascii_ else len(line.decode())
        w = line.lower().split()
        if 0 < len(w) < min_words:
            if not run:
                first, start = number, at
            run += w
            end = at + chars
        else:
            if len(run) >= min_words:
                yield first, start, end, run
            run = []
            if w:
                yield number, at, at + chars, w
        at += chars + 1
    if len(run) >= min_words:
        yield first, start, end, run


class Hasher:
    """MinHash bands of many paragraphs at once."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def bands_of(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """A row of band hashes for each paragraph's shingles (at least one)."""
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(s) for p in paragraphs for s in p), np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])[:-1]]).astype(np.int64)
        out = np.full((len(paragraphs), self.bands), np.uint64(0x9E3779B97F4A7C15))
        for k in range(self.bands * self.rows):
            low = np.minimum.reduceat((h * self.a[k] + self.b[k]) >> np.uint64(16), starts)
            j = k // self.rows
            out[:, j] = (out[:, j] ^ low) * np.uint64(0xFF51AFD7ED558CCD)
            out[:, j] ^= out[:, j] >> np.uint64(33)
        names = np.arange(self.bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (out ^ names).view(np.int64)


def bitmap(grams: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of distinct shingles, and the parities of their hashes in ``64 * MAP`` bits."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, set(grams)), np.uint64)
    odd = np.bincount((h % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return len(h), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fields(docs: DataFrame, *columns: str) -> list[T.StructField]:
    return [docs.schema[c] for c in columns]


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Rows of paragraphs of ``docs(id, doc, text)``: first line, place in code points, key (a hash of the words) and bands ``b0``, ``b1`` and so on.

    A document without such a paragraph has one row with a null key.
    """
    bands, rows = tuned(similarity, recall)
    names = ["number", "start", "end", "key", *(f"b{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bands, rows)

        def flushed(batch: pa.RecordBatch, held: list[tuple], grams: list[list[bytes]]) -> pa.RecordBatch:
            at, *places = zip(*held)
            at = pa.array(at, pa.int32())
            full = np.fromiter((bool(g) for g in grams), bool)
            b = np.zeros((len(held), bands), np.int64)
            if full.any():
                b[full] = hasher.bands_of([g for g in grams if g])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(places, kinds)] + [pa.array(b[:, i], mask=~full) for i in range(bands)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays], names=["id", "doc", *names])

        for batch in batches:
            held: list[tuple] = []
            grams: list[list[bytes]] = []
            n = 0
            for i, text in enumerate(byte_texts(batch.column(2))):
                any_ = False
                for number, start, end, w in cut(text, min_words):
                    key = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(w), 7)).view(np.int64))
                    held.append((i, number, start, end, key))
                    grams.append(shingles(w))
                    n += len(w)
                    any_ = True
                    if n >= _SLICE:
                        yield flushed(batch, held, grams)
                        held, grams, n = [], [], 0
                if not any_:
                    held.append((i, None, None, None, None))
                    grams.append([])
            if held:
                yield flushed(batch, held, grams)

    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), *[T.LongType()] * bands]
    schema = T.StructType([*_fields(docs, "id", "doc"), *map(T.StructField, names, kinds)])
    return bounded(docs).select("id", "doc", "text").mapInArrow(run, schema)


def _facts(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """Rows ``(key, size, m0, m1, ..., body)`` of ``spots(key, id, doc, start, end)``, cut out of ``docs(id, doc, text)``: one for each key."""
    asked = spots.groupBy("id", "doc").agg(F.collect_list(F.struct("key", "start", "end")).alias("spots"))  # at most one document's paragraphs
    on = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.doc") == F.col("s.doc"))
    texts = docs.alias("d").join(asked.alias("s"), on).select("s.spots", "d.text")
    names = ["key", "size", *(f"m{i}" for i in range(MAP)), "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spots_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in spots_:
                    body = text[s["start"] : s["end"]]
                    size, parities = bitmap(shingles(body.encode().lower().split()))
                    rows.append((s["key"], size, *parities.tolist(), body))
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * MAP, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kinds = ["bigint", "int", *["bigint"] * MAP, "string"]
    found = bounded(texts).mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))
    return found.dropDuplicates(["key"])  # repeated rows of documents give a key again


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b, x, y)`` whose exact Jaccard similarity meets ``similarity``, as ``(x, y)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(x, y) >= similarity for x, y in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)))]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    left = bodies.select(F.col("key").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("key").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(left, "a").join(right, "b").select("x", "y", "body_a", "body_b").mapInArrow(run, "x bigint, y bigint")


def _may_meet(similarity: float) -> Column:
    """Whether members ``a`` and ``b`` of a bucket are in different components and may meet the similarity, by exact bounds."""
    apart = F.lit(0)
    for i in range(MAP):
        apart = apart + F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}")))
    bound = apart <= (F.col("a.size") + F.col("b.size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    sizes = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * similarity - 1e-6
    return (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") != F.col("b.root")) & sizes & bound


def linked(crowd: DataFrame, facts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows ``(key, root)`` of the keys of ``facts``: root names the component of all verified pairs that share a bucket of ``crowd(bucket, key)``."""
    n = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bodies = facts.select("key", "body")
    roots = stored(facts.select("key", F.col("key").alias("root")))
    live = stored(crowd.join(facts.drop("body").withColumn("root", F.col("key")), "key"))
    hubs_a_bucket, turn = 1, 0
    while True:
        mixed = stored(live.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket"))
        a, b = live.alias("a"), live.alias("b")
        # The first round needs no proof that a partner is left: one hub a bucket.  Later ones write it, as a join before a window can't split a hot bucket.
        able = live.join(mixed, "bucket", "left_semi") if not turn else stored(a.hint("merge").join(b, _may_meet(similarity), "left_semi"))
        order = W.partitionBy("bucket").orderBy(F.xxhash64("key", F.lit(turn)), "key")
        hubs = stored(able.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs_a_bucket).drop("place"))
        discard(able)
        if hubs.isEmpty():
            discard(hubs, live, mixed)
            return roots
        pairs = hubs.alias("a").hint("merge").join(b, _may_meet(similarity)).select(
            F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b"), F.col("a.root").alias("x"), F.col("b.root").alias("y")
        ).dropDuplicates(["a", "b"])
        near = stored(_verified(pairs.repartition(n, "a", "b"), bodies, similarity).distinct())
        merged = stored(components(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("above")))
        done = hubs.select("bucket", "key")
        rooted = lambda df: df.join(merged, "root", "left").withColumn("root", F.coalesce("above", "root")).drop("above")
        before = live, roots, hubs, near
        roots = stored(rooted(roots).select("key", "root"))
        live = stored(rooted(live.join(mixed, "bucket", "left_semi").join(done, ["bucket", "key"], "left_anti")))
        discard(*before, merged, mixed)
        hubs_a_bucket, turn = hubs_a_bucket * 16, turn + 1


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Rows of every paragraph ``(id, doc, number, start, end, cluster, count, first_id, kept)``.

    ``cluster`` is the smallest key of the paragraph's component and ``count`` its occurrences; ``kept`` is true for the first
    occurrence, by id (nulls last), row and place, and for paragraphs that occur once; ``first_id`` is the id of the first.
    ``number`` is the paragraph's first line.  Ids may have any type that has an order.
    ``doc`` (a hash of the text) tells rows with equal ids apart; rows equal in both are one document whose
    figures add up, kept or removed together.  Documents without a paragraph (null, empty, or of fewer than ``min_words`` words between blank
    lines) have one row with a null number.
    """
    bands, _ = tuned(similarity, recall)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))
    found = stored(paragraphs(rows, min_words, similarity, recall))
    full = found.where("key is not null")
    distinct = stored(full.groupBy("key").agg(F.count("*").alias("n"), *(F.min(f"b{i}").alias(f"b{i}") for i in range(bands))))
    members = distinct.select("key", F.explode(F.array(*(f"b{i}" for i in range(bands)))).alias("bucket"))
    shared = stored(members.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("bucket"))
    crowd = stored(members.join(shared, "bucket", "left_semi"))
    keys = stored(distinct.select("key", "n"))
    discard(distinct, shared)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "start", "end")
    spots = full.join(crowd.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(place).alias("at"))
    spots = stored(spots.select("key", "at.id", "at.doc", "at.start", "at.end"))
    facts = stored(_facts(rows, spots))
    discard(spots)
    roots = linked(crowd, facts, similarity)
    discard(crowd, facts)
    named = keys.join(roots, "key", "left").select("key", "n", F.coalesce("root", "key").alias("cluster"))
    crowds = named.groupBy("cluster").agg(F.sum("n").alias("count"))
    many = stored(named.join(crowds.where("count > 1"), "cluster").select("key", "cluster", "count"))
    discard(keys, roots)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "start")
    first = full.join(many, "key").groupBy("cluster").agg(F.min(place).alias("first"))
    headed = stored(many.join(first, "cluster"))
    out = found.join(headed, "key", "left").select(
        "id", "doc", "number", "start", "end", F.coalesce("cluster", "key").alias("cluster"), F.when(F.col("key").isNotNull(), F.coalesce("count", F.lit(1))).alias("count"),
        F.col("first.id").alias("first_id"), (F.col("count").isNull() | F.col("first").eqNullSafe(place)).alias("kept"),
    )
    out = stored(out)
    discard(found, many, headed)
    return out


def by_document(rows: DataFrame) -> DataFrame:
    """One row for each document: ``id, doc, n_paragraphs, n_repeated, n_removed, removed, first_ids``.

    ``removed`` are the places ``start:end`` of the paragraphs that go, comma-joined in order; ``first_ids`` are the distinct ids, in
    order, of the documents where its repeated paragraphs stand first (its own among them).
    """
    gone = ~F.col("kept")
    spots = F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end"))))  # at most the lines of one document
    return rows.groupBy("id", "doc").agg(
        F.count("number").alias("n_paragraphs"),
        F.count(F.when(F.col("count") > 1, 1)).alias("n_repeated"),
        F.count(F.when(gone, 1)).alias("n_removed"),
        F.array_join(F.transform(spots, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias("removed"),
        F.array_sort(F.collect_set(F.when(F.col("count") > 1, F.col("first_id")))).alias("first_ids"),
    )


_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def anchors(text: bytes, size: int = MIN_WORDS, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of a text with A-Z lower-cased, and the place of each one's first word; none in fewer than ``passage`` words."""
    w = text.lower().split()
    n, reach = len(w) - size + 1, passage - size + 1
    if n < reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    powers = np.cumprod(np.full(len(w), _BASE, np.uint64))
    back = np.cumprod(np.full(n, pow(_BASE, -1, _MASK + 1), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])
    h = (sums[size:] - sums[:-size]) * back
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, reach).argmin(axis=1) + np.arange(n - reach + 1))
    v = h[at]
    if (v[1:] == v[:-1]).any():  # words that go round and round: one anchor for each reach is enough
        some: list[int] = []
        for i, (x, a) in enumerate(zip(v.tolist(), at.tolist())):
            if not some or v[some[-1]] != x or a - at[some[-1]] >= reach:
                some.append(i)
        v, at = v[some], at[some]
    return v, at


def _word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in code points."""
    b = np.frombuffer(text, np.uint8)
    held = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
    edges = np.flatnonzero(held[1:] != held[:-1])
    if not text.isascii():
        edges = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[edges]
    return edges[::2], edges[1::2]


def _anchored(docs: DataFrame, size: int, passage: int) -> DataFrame:
    """Rows ``(id, doc, anchor, start, end)`` of the anchors of ``docs(id, doc, text)``, places in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for i, text in enumerate(byte_texts(batch.column(2))):
                v, at = anchors(text, size, passage)
                if len(v):
                    starts, ends = _word_places(text)
                    found.append((v.view(np.int64), starts[at], ends[at + size - 1]))
                    rows.append(np.full(len(v), i))
            if found:
                take = pa.array(np.concatenate(rows))
                v, start, end = (pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), v, start, end], names=["id", "doc", "anchor", "start", "end"])

    schema = T.StructType([*_fields(docs, "id", "doc"), *(T.StructField(c, T.LongType()) for c in ("anchor", "start", "end"))])
    return bounded(docs).select("id", "doc", "text").mapInArrow(run, schema)


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = MIN_WORDS, passage: int = PASSAGE) -> DataFrame:
    """Rows ``(id, doc, n_passages, passages, passage_ids)`` of the documents that hold an anchor of another place.

    ``passages`` are the places ``start:end`` of the runs of words that stand earlier, by id (nulls last), row and place, comma-joined in
    order: anchors that overlap are one run, which at either end may be up to ``passage - size`` words short of the equal words.
    ``passage_ids`` are the distinct ids, in order, of the documents where repeated anchors stand first (its own among them).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))
    spots = stored(_anchored(rows, size, passage))
    # Both sides of a join are stored tables: then the planner can split an anchor that a third of all texts hold.
    again = stored(spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    hits = stored(spots.join(again, "anchor", "left_semi"))
    discard(spots, again)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "start")
    first = stored(hits.groupBy("anchor").agg(F.min(place).alias("first")))
    hits = hits.join(first, "anchor").select("id", "doc", "start", "end", F.col("first.id").alias("first_id"), (~F.col("first").eqNullSafe(place)).alias("gone"))
    found = hits.groupBy("id", "doc").agg(
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.struct("start", "end")))).alias("s"),  # at most the anchors of one document
        F.array_sort(F.collect_set("first_id")).alias("passage_ids"),
    )
    starts = F.filter("s", lambda x, i: (i == 0) | (x.start > F.get("s", i - 1).end))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (x.end < F.get("s", i + 1).start))
    runs = F.zip_with(starts, ends, lambda a, b: F.concat_ws(":", a.start.cast("string"), b.end.cast("string")))
    return found.select("id", "doc", F.size(starts).cast("long").alias("n_passages"), F.array_join(runs, ",").alias("passages"), "passage_ids")
