"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (0 to 3 bytes) with escape
method C: in a context seen n times with t distinct symbols, a symbol seen c times costs
-log2(c / (n + t)) bits and an escape to the next shorter context -log2(t / (n + t)); the
last resort is 8 bits.  A context that a tree lacks is skipped free of charge.  Statistics
are frozen after training, so a symbol's exact code length depends on its last four
bytes only, and is computed once for every n-gram of the trees; scoring is then a
vectorised lookup over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded, flat_bytes

ORDER = 4  # bytes of the longest n-gram: three of context and the symbol
_BLOCK = 1 << 18
_SPACE, _START = 32, 0
#: Letters of any script stay, A-Z become a-z, all else is a space; runs of spaces count once.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else _SPACE for b in range(256)], np.uint8)


def fold(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text behind three start marks, and the offsets of the texts in them."""
    n = len(ends) - 1
    kept = _FOLD[raw]
    blank = kept == _SPACE
    keep = np.ones(len(kept), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = ends[:-1][ends[:-1] < len(kept)]
    keep[inner] = True  # a text's first space isn't the last text's
    before = np.concatenate([[0], np.cumsum(keep)])
    kept, ends = kept[keep], before[ends]
    pad = ORDER - 1
    return np.insert(kept, np.repeat(ends[:-1], pad), _START), ends + pad * np.arange(n + 1)


def slices(ends: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, each of one text at least."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def grams(flat: np.ndarray, k: int, start: int, stop: int) -> np.ndarray:
    """The k-grams that end at positions start to stop - 1, first byte highest."""
    out = flat[start - k + 1 : stop - k + 1].astype(np.uint32)
    for i in range(k - 2, -1, -1):
        out = out << np.uint32(8) | flat[start - i : stop - i]
    return out


class Lookup:
    """A static hash from 32-bit keys to their rows: levels of direct tables, each for the keys that the last couldn't place."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = np.arange(len(keys), dtype=np.int32)
        while len(keys):
            shift = 32 - max(6, int(np.ceil(np.log2(4 * len(keys)))))
            slot = self._slot(keys, shift)
            held, row = np.zeros(1 << (32 - shift), np.uint32), np.full(1 << (32 - shift), -1, np.int32)
            held[slot], row[slot] = keys, rows
            self.levels.append((shift, held, row))
            left = row[slot] != rows
            keys, rows = keys[left], rows[left]

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(shift)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        todo, left = slice(None), keys
        for shift, held, row in self.levels:
            slot = self._slot(left, shift)
            got = np.where(held[slot] == left, row[slot], -1)
            out[todo] = got
            miss = np.flatnonzero(got < 0)
            if not len(miss):
                break
            todo = miss if isinstance(todo, slice) else todo[miss]
            left = left[miss]
        return out


@dataclass
class Model:
    """Frozen trees: for each order the n-grams' code lengths, and the contexts' escape lengths, by language."""

    langs: list[str]
    cost: list[tuple[Lookup, np.ndarray]]  # of n-grams of 1 to ORDER bytes
    escape: list[tuple[Lookup, np.ndarray]]  # of contexts of 0 to ORDER - 1 bytes

    def lengths(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of each k-gram's last symbol after its first k - 1, one column a language."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        find, table = self.cost[k - 1]
        row = find(keys)
        out = table[row] if len(table) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            left = keys[miss]
            more = self.lengths(left & np.uint32((1 << 8 * (k - 1)) - 1) if k < 5 else left, k - 1)
            find, table = self.escape[k - 1]
            if len(table):
                known = find(left >> np.uint32(8))
                has = known >= 0
                more[has] += table[known[has]]
            out[miss] = more
        return out

    def score(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total bits of each text by language, and its symbols; some megabytes of texts are unfolded at a time."""
        parts = [self._score(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in slices(ends)]
        bits = np.concatenate([np.zeros((0, len(self.langs))), *(b for b, _ in parts)])
        return bits, np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def _score(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = fold(raw, ends)
        n, pad = len(ends) - 1, ORDER - 1
        bits = np.zeros((n, len(self.langs)))
        symbols = np.diff(at) - pad
        for start in range(pad, len(flat), _BLOCK):
            stop = min(start + _BLOCK, len(flat))
            cost = self.lengths(grams(flat, ORDER, start, stop)).astype(np.float64)
            cost[flat[start:stop] == _START] = 0
            first = int(np.searchsorted(at, start, "right")) - 1
            edges = np.concatenate([[0], at[first + 1 : np.searchsorted(at, stop, "left")] - start]).astype(np.int64)
            sums = np.add.reduceat(cost, edges, axis=0)
            bits[first : first + len(edges)] += sums
        return bits, symbols


def _counts(flat: np.ndarray, langs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(language, order, n-grams, counts) of symbols that belong to languages (-1: start marks)."""
    pad = ORDER - 1
    for k in range(1, ORDER + 1):
        keys = grams(flat, k, pad, len(flat))
        for lang in np.unique(langs[langs >= 0]):
            got, n = np.unique(keys[langs[pad:] == lang], return_counts=True)
            yield int(lang), k, got, n


def _rows(flat: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, k, keys, n in _counts(flat, of):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])


def train(docs: DataFrame, sample_docs: int = 1500, min_count: int = 2, max_grams: int = 1 << 18, lang: str = "lang", text: str = "text") -> Model:
    """Trees from rows with both ``lang`` and ``text``.

    ``sample_docs`` bounds the expected number of whole documents taken for each language, by a hash of
    the text; n-grams seen fewer than ``min_count`` times are pruned, and ``max_grams`` bounds the
    n-grams of one language and order that are kept, the most frequent first.  Without labelled rows
    the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], [(Lookup(np.zeros(0, np.uint32)), np.zeros((0, 0), np.float32))] * ORDER, [(Lookup(np.zeros(0, np.uint32)), np.zeros((0, 0), np.float32))] * ORDER)
    index = F.create_map(*(x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))))
    part = F.create_map(*(x for name in langs for x in (F.lit(name), F.lit(min(1.0, sample_docs / sizes[name])))))
    taken = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = flat_bytes(batch.column(1))
            own = batch.column(0).to_numpy().astype(np.int64)
            for a, b in slices(ends):
                flat, at = fold(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                of = np.repeat(own[a:b], np.diff(at))
                of[flat == _START] = -1
                yield from _rows(flat, of)

    counted = bounded(taken).select(index[F.col("lang")].alias("lang"), "text").mapInArrow(run, "lang int, k int, gram bigint, n bigint")
    summed = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    first = F.row_number().over(W.partitionBy("lang", "k").orderBy(F.desc("n"), "gram"))  # limited before it is shuffled, as each row count is bounded
    got = summed.withColumn("first", first).where(F.col("first") <= max_grams).select("lang", "k", "gram", "n").toArrow()
    columns = [got.column(c).to_numpy() for c in ("lang", "k", "gram", "n")]
    return freeze(langs, *columns, max_grams=max_grams)


def freeze(langs: list[str], lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray, max_grams: int = 1 << 18) -> Model:
    """The model of counted n-grams."""
    size = len(langs)
    model = Model(langs, [], [])
    for k in range(1, ORDER + 1):
        per = []
        for i in range(size):
            mine = (lang == i) & (order == k)
            keys, c = gram[mine].astype(np.uint32), n[mine].astype(np.float64)
            top = np.lexsort((keys, -c))[:max_grams]
            per.append((keys[top], c[top]))
        union = np.unique(np.concatenate([np.zeros(0, np.uint32), *(keys for keys, _ in per)]))
        contexts = np.unique(union >> np.uint32(8)) if k > 1 else np.zeros(min(1, len(union)), np.uint32)
        find, find_context = Lookup(union), Lookup(contexts)
        suffix = union & np.uint32((1 << 8 * (k - 1)) - 1)
        cost = model.lengths(suffix, k - 1).astype(np.float64)
        escape = np.zeros((len(contexts), size))
        for i, (keys, c) in enumerate(per):
            if not len(keys):
                continue
            where = find_context(keys >> np.uint32(8) if k > 1 else np.zeros(len(keys), np.uint32))
            total, kinds = np.bincount(where, c, len(contexts)), np.bincount(where, minlength=len(contexts))
            seen = kinds > 0
            escape[seen, i] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            mine = find_context(union >> np.uint32(8) if k > 1 else np.zeros(len(union), np.uint32))
            cost[:, i] += escape[mine, i]
            cost[find(keys), i] = np.log2((total + kinds)[where] / c)
        model.cost.append((find, cost.astype(np.float32)))
        model.escape.append((find_context, escape.astype(np.float32)))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with ``lang_pred``, ``score`` and ``bits``.

    ``lang_pred`` has the shortest code (ties: the first by name); it is ``und`` for a text
    that is null or has no letter, or if the model knows no language.  ``score`` is the prediction's
    share of 2 ** (-8 * bits a symbol) over the languages, 0 for ``und``; ``bits`` are the best code's bits a symbol, null
    for ``und``.  Columns of these names are replaced.  Texts are read whole, of any length.
    """
    added = ["lang_pred", "score", "bits"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            raw, ends = flat_bytes(batch.column(batch.num_columns - 2))
            n = len(ends) - 1
            letter = np.asarray(batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            best, score, rate = np.full(n, len(m.langs)), np.zeros(n), np.full(n, np.nan)
            if m.langs and n:
                bits, symbols = m.score(raw, ends)
                mean = bits / np.maximum(symbols, 1)[:, None]
                first = mean.argmin(1)
                low = mean[np.arange(n), first]
                share = 1 / np.exp2(-8 * (mean - low[:, None])).sum(1)
                best, score, rate = np.where(letter, first, best), np.where(letter, share, 0.0), np.where(letter, low, np.nan)
            new = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rate, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=[*keep, *added])

    schema = T.StructType([*docs.select(*keep).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return bounded(docs).select(*keep, F.col(text).alias("__leafmill_text"), F.col(text).rlike(r"\p{L}").alias("__leafmill_letter")).mapInArrow(run, schema)
