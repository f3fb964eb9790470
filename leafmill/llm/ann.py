"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (principal axes, then iterative quantisation) turn each vector into a binary
code, which is split into substrings of 16 bits.  All rows are coded once and stored with their code; every block of rows
indexes each substring's values in lists.  A query probes, in each substring, the lists of all values within a few bits of
its own.  By the pigeonhole principle that retrieves every code within ``substrings * (bits + 1) - 1`` bits; what is probed
is reranked by the exact cosine of the original vectors.  How many substrings a code has, and how far each is probed, is
calibrated on the sample: the least share of rows for the wanted recall.

Queries are a stated set, taken in blocks of a fixed size; each block is compared with all rows
where these lie, so no row is shuffled, and only the k best of each task leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._store import stored

_SUB = 16  # bits of a substring, fewer only where vectors are shorter
_MOST = 32  # substrings of a code at most
_FIT = 4_096  # rows of the sample that rotations are fitted on
_POP = np.array([bin(i).count("1") for i in range(1 << _SUB)], np.uint8)
_ROWS = 65_536  # rows of a block that is indexed together


@dataclass
class Coder:
    """Learned rotations, the bits of a substring, how far each is probed, and what the sample showed for that."""

    mean: np.ndarray
    rotation: np.ndarray
    size: int
    most: int
    recall: float = 1.0
    probed: float = 1.0

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // self.size

    @property
    def radius(self) -> int:
        """Every code within so many bits of a query's is retrieved."""
        return self.substrings * (self.most + 1) - 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of substring values for each unit vector."""
        bits = ((x - self.mean) @ self.rotation > 0).reshape(len(x), self.substrings, self.size)
        return (bits @ (1 << np.arange(self.size))).astype(np.uint16)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rotations(x: np.ndarray, bits: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and columns of independent rotations of the principal axes, each turned so that signs lose little; at least ``bits``."""
    mean = x.mean(0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1]
    p = (x - mean) @ axes
    out: list[np.ndarray] = []
    while sum(t.shape[1] for t in out) < bits:
        turn = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
            turn = (u @ vt).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def learn(x: np.ndarray, k: int = 5, recall: float = 0.95, rounds: int = 8, queries: int = 200, seed: int = 0) -> Coder:
    """A coder for the unit vectors ``x`` that probes the least of the sample for the share ``recall`` of the ``k`` nearest in it.

    More rows than the sample has only bring the nearest closer, so the choice errs towards more recall.
    """
    size = min(_SUB, x.shape[1])
    rng = np.random.default_rng(seed)
    mean, rotation = _rotations(x[rng.permutation(len(x))[:_FIT]], size * _MOST, rounds, rng)
    whole = Coder(mean, rotation, size, size)
    codes = whole.codes(x)
    asked = rng.permutation(len(x))[:queries]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    if not best.size:
        return whole
    fewest = whole
    far = np.full(near.shape, 255, np.uint8)
    for n in range(_MOST):  # the nearest of the first n + 1 substrings decides whether a row is probed
        far = np.minimum(far, _POP[codes[asked, n][:, None] ^ codes[None, :, n]])
        held = np.take_along_axis(far, best, 1)
        for most in range(size):
            found = float((held <= most).mean())
            if found >= recall:
                share = float((far <= most).mean())
                if share < fewest.probed:
                    fewest = Coder(mean, rotation[:, : size * (n + 1)], size, most, found, share)
                break
    return fewest


class Index:
    """The substring lists of one block of codes."""

    def __init__(self, codes: np.ndarray, size: int):
        self.n = len(codes)
        self.lists = []
        for values in codes.T:
            order = np.argsort(values, kind="stable")
            self.lists.append((order, np.searchsorted(values[order], np.arange((1 << size) + 1))))

    def probe(self, code: np.ndarray, near: np.ndarray) -> np.ndarray:
        """All rows with a substring that is one of ``near`` flips away from the query's."""
        hit = np.zeros(self.n, bool)
        for value, (order, starts) in zip(code, self.lists):
            values = near ^ int(value)
            first, n = starts[values], starts[values + 1] - starts[values]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit[order[at]] = True
        return np.flatnonzero(hit)


def flips(size: int, most: int) -> np.ndarray:
    """All substrings of at most ``most`` bits."""
    return np.flatnonzero(_POP[: 1 << size] <= most)


def _search(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, size: int, most: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the ``k`` best rows of one block for each query."""
    index, near = Index(codes, size), flips(size, most)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    for n in range(len(query_ids)):
        found = index.probe(q_codes[n], near)
        found = found[ids[found] != query_ids[n]]
        if not len(found):
            continue
        rough = x[found] @ q[n] / norms[found]
        if len(found) > k:
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-9 * np.abs(rough).max()]
        y = x[found]
        score = np.einsum("ij,ij->i", y, np.broadcast_to(q[n], y.shape)) / (norms[found] * np.sqrt(np.einsum("i,i->", q[n], q[n])))
        best = np.lexsort((ids[found], -score))[:k]
        yield n, ids[found][best], score[best]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows ``(id, v)`` that can take part: vectors of finite components, not null, empty or zero, with ids that are whole numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).try_cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))


_FOUND = "query_id bigint, query bigint, vec_id bigint, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """``rows(id, v)`` with ``code``, the substring values."""
    shipped = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shipped.value.codes(unit(_matrix(batch.column(1)))).astype(np.int32)
                ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["id", "v", "code"])

    schema = T.StructType([*rows.schema, T.StructField("code", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def search(
    vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, query_block: int = 8_192, recall: float = 0.95
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine found for each row where ``asked`` holds.

    ``asked`` is a condition on the column ``id``.  A query's own id is no candidate; ties go to the smaller id.  Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do those whose length isn't the commonest (ties: the
    smaller length), nor rows whose id is no whole number.  Candidates of equal ids are rows of their own; equal queries (id and vector) are
    one, and queries of one id with different vectors are ranked apart.  An empty table gives no rows.  ``sample`` bounds the expected number of
    vectors that the coder is learned on, taken by a hash of the id; all rows are indexed and searched.  ``query_block`` bounds the queries that are
    held at a time; further blocks follow, over the same stored codes.  A query that finds fewer than ``k`` is asked again of all rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = sizes.dim, sizes.n
    rows = rows.where(F.size("v") == dim)
    taken = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)))
    x = _matrix(taken.orderBy("id").select("v").toArrow().column("v").combine_chunks())
    size = min(_SUB, dim)
    coder = learn(unit(x), k, recall) if len(x) else Coder(np.zeros(dim), np.eye(dim)[:, :size], size, size)
    index = stored(coded(rows, coder))
    queries = index.where(asked).dropDuplicates(["id", "v"]).withColumn("query", F.xxhash64("v"))
    found = _asked(index, queries, coder.size, coder.most, k, query_block)
    counts = found.groupBy("query_id", "query").agg(F.count("*").alias("n"))
    few = queries.join(counts, (F.col("id") == F.col("query_id")) & (queries["query"] == counts["query"]), "left").where(F.coalesce("n", F.lit(0)) < k)
    few = stored(few.select("id", "v", "code", queries["query"]))
    if few.isEmpty():
        return found.drop("query")
    again = _asked(index, few, coder.size, coder.size, k, query_block)
    rest = found.join(few.select(F.col("id").alias("query_id"), "query"), ["query_id", "query"], "left_anti").select(*found.columns)
    return rest.union(again).drop("query")


def _asked(index: DataFrame, queries: DataFrame, size: int, most: int, k: int, query_block: int) -> DataFrame:
    """Rows ``(query_id, query, rank, vec_id, score)`` of the best ``k`` that each of ``queries(id, query, v, code)`` finds in ``index(id, v, code)``."""
    context = index.sparkSession.sparkContext
    blocks = max(1, -(-queries.count() // query_block))
    parts = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("id", "query", F.lit("block")), F.lit(blocks)) == b).select("id", "query", "v", "code").toArrow()
        q, codes = (_matrix(mine.column(c).combine_chunks()) for c in ("v", "code"))
        shipped = context.broadcast((mine.column("id").to_numpy(), mine.column("query").to_numpy(), q, codes))
        part = index.mapInArrow(_searcher(shipped, size, most, k), _FOUND)
        best = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        parts.append(stored(part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query", "rank", "vec_id", "score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _searcher(shipped, size: int, most: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, names, q, q_codes = shipped.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for ids, x, codes in _joined(batches):
            for n, some, score in _search(ids, x, codes, query_ids, q, q_codes, size, most, k):
                some, score = np.concatenate([best[n][0], some]), np.concatenate([best[n][1], score])
                top = np.lexsort((some, -score))[:k]
                best[n] = (some[top], score[top])
        counts = [len(a) for a, _ in best]
        if sum(counts):
            columns = np.repeat(query_ids, counts), np.repeat(names, counts), np.concatenate([a for a, _ in best]), np.concatenate([s for _, s in best])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query", "vec_id", "score"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches ``(id, v, code)`` as blocks of about ``_ROWS`` rows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(2))))
        if sum(len(i) for i, _, _ in held) >= _ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))
