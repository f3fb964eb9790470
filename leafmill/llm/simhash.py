"""Near-duplicate documents by SimHash, linked through shared ball variants.

Fingerprints are hashed in Python over Arrow batches.  Links are found without
comparing pairs:

1. rows with equal fingerprints collapse to one node, with a partial minimum;
2. a filter that loses nothing: the bits fall into ``radius + 1`` blocks.  Two
   fingerprints within ``radius`` bits that differ at all differ in some block; with
   that block masked off they are within ``radius - 1`` bits and so share a variant
   of the ball of half that.  Each fingerprint emits these balls; one whose variants
   nobody shares has no neighbour.
3. the rest emit all their variants within the lower and the upper half of the
   radius, and shuffle on the full variant.  Where a variant holds a fingerprint
   ``a`` of the lower ball, every fingerprint there lies within the radius of ``a``
   (triangle inequality): these collisions are verified by their distances, and the
   group becomes a star around ``a`` rather than all its pairs.
4. components of the stars, then the smallest document of each.

A variant holds a fingerprint once at most, and equal texts are one fingerprint, so one variant's rows are as many as different near copies share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded, byte_texts
from leafmill.llm._components import components
from leafmill.llm._store import stored

BITS = 64
_CHUNK = 65_536  # shingles held as numbers at a time


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 text: bit i is set if over half of the shingles' XXH64 have it; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = w[at : min(at + _CHUNK, n) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) and the signed 64-bit ``out``, which replaces a column of that name.

    A null text counts as empty; texts are read whole, of any length.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in byte_texts(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*keep, out])

    schema = T.StructType([*docs.select(*keep).schema, T.StructField(out, T.LongType())])
    return bounded(docs).select(*keep, F.col(text).alias("__leafmill_text")).mapInArrow(run, schema)


def _flips(n: int, bits: list[int]) -> list[int]:
    """Every signed mask of exactly ``n`` of the ``bits``."""
    return [int(np.uint64(sum(1 << b for b in some)).view(np.int64)) for some in combinations(bits, n)]


def _ball(most: int, bits: list[int]) -> list[int]:
    return [m for n in range(most + 1) for m in _flips(n, bits)]


def _longs(values: list[int]) -> F.Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _signed(mask: int) -> int:
    return int(np.uint64(mask).view(np.int64))


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between the distinct ``fp`` of ``prints``, whose components are those of all pairs within ``radius`` bits."""
    blocks = [list(range(i, BITS, radius + 1)) for i in range(radius + 1)]
    masked = []
    for tag, block in enumerate(blocks):
        kept = [b for b in range(BITS) if b not in block]
        keep = _signed(sum(1 << b for b in kept))
        name = _signed(sum((tag >> i & 1) << b for i, b in enumerate(block)))  # tells the blocks apart, in the bits that are masked off
        masked += [(keep, flip ^ name) for flip in _ball(radius // 2, kept)]
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    variants = prints.repartition(n, "fp").select(
        "fp", F.explode(F.arrays_zip(_longs([k for k, _ in masked]).alias("keep"), _longs([f for _, f in masked]).alias("flip"))).alias("v")
    ).select("fp", F.expr("(fp & v.keep) ^ v.flip").alias("variant"))
    # A variant holds a fingerprint once at most, so even one crowd of near copies is a small part of all variants.
    others = F.count("*").over(W.partitionBy("variant"))
    near = stored(variants.select("fp", others.alias("n")).where("n > 1").select("fp").distinct())
    low, high = radius // 2, radius - radius // 2
    bits = list(range(BITS))
    around = [(m, True) for m in _ball(low, bits)] + [(m, False) for n in range(low + 1, high + 1) for m in _flips(n, bits)]
    full = near.repartition(n, "fp").select(
        "fp", F.explode(F.arrays_zip(_longs([m for m, _ in around]).alias("flip"), _longs([int(c) for _, c in around]).alias("close"))).alias("v")
    ).select("fp", F.expr("fp ^ v.flip").alias("variant"), (F.col("v.close") == 1).alias("close"))
    # A window and no join: the planner takes the exploded side for as small as its few fingerprints and would broadcast it.
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(W.partitionBy("variant"))
    return full.select("fp", hub.alias("hub")).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3) -> DataFrame:
    """Rows ``(id, hash, fp, component_id, root)``, one for each row of ``docs``; hash is the XXH64 of the text, root a fingerprint that names the component.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits,
    itself included.  Rows with equal fingerprints are linked.  A null or empty text has
    fingerprint 0 and is linked like any other; null ids are ignored by the minimum, and
    a component of null ids only has a null id.  Repeated rows are returned as often as given.
    """
    prints = stored(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")), "text", "fp", words, ["id", "hash"]))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    crowd = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(crowd, "root").select("fp", "component_id", "root"))
    return prints.join(named, "fp").select("id", "hash", "fp", "component_id", "root")
