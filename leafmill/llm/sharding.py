"""Contiguous shards of near-equal bytes.

Rows are ordered by content hash, then id, so copies lie side by side.  Narrow rows
(no text) are range-partitioned and sorted; each partition's running totals are
shifted by the totals of the partitions before it, and the global prefix sum is cut
at equal targets.  A cut that falls into a group of equal texts moves to the group's
nearer end where the group is small against a shard; a large group is cut where
the target falls, so that no group can unbalance the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._store import stored

#: A group of copies up to this part of a shard's target isn't cut.
WHOLE = 0.02


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, and the bytes and rows before each row in its partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    total = rows = 0
    for batch in batches:
        size = batch.column(batch.schema.get_field_index("_size")).to_numpy()
        ends = total + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - size), pa.array(rows + np.arange(n, dtype=np.int64))],
            names=[*batch.schema.names, "_part", "_before", "_index"],
        )
        total, rows = int(ends[-1]) if n else total, rows + n


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text: str = "text", overhead: int = 8, partitions: int | None = None) -> DataFrame:
    """Rows ``(id, size, text_crc32, shard, slot)``, one for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``; ``slot`` counts
    from 0 without gaps inside a shard.  Repeated rows and null ids take slots of their own.  An
    empty input gives no rows; with fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("_size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        )
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "_hash", "id", "_crc").sortWithinPartitions("_hash", "id", "_crc")
    schema = T.StructType([*ordered.schema, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_index", T.LongType())])
    ordered = stored(ordered.mapInArrow(_running, schema))
    # One row a partition: their number is a setting and doesn't follow the rows.
    parts = ordered.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("bytes", "rows")))
    placed = ordered.join(F.broadcast(shifts), "_part").select(
        "id", "_size", "_crc", "_hash", (F.col("_before") + F.col("_bytes")).alias("_at"), (F.col("_index") + F.col("_rows")).alias("_row")
    )
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    cuts = [total * k // n_shards for k in range(1, n_shards)]
    if cuts and total:
        here = F.array(*(F.lit(c) for c in cuts))
        crossed = placed.where(F.exists(here, lambda c: (F.col("_at") < c) & (c < F.col("_at") + F.col("_size")) | (c == F.col("_at"))))
        split = [r[0] for r in crossed.select("_hash").distinct().collect()]  # at most one a cut
        groups = placed.where(F.col("_hash").isin(split)).groupBy("_hash").agg(F.min("_at").alias("a"), F.max(F.col("_at") + F.col("_size")).alias("b"), F.count("*").alias("n")).collect()
        for g in groups:
            if g.n > 1 and g.b - g.a <= WHOLE * total / n_shards:
                cuts = [(g.a if c - g.a <= g.b - c else g.b) if g.a <= c <= g.b else c for c in cuts]
    shard = sum((F.when(F.col("_at") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = placed.select("id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), shard.alias("shard"), "_row")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
