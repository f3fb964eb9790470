"""Stores of keyed records that are changed in place: versions of buckets, published when they are whole.

A store is a folder of versions, ``v=3/bucket=17/*.json``.  A change rewrites the buckets that its keys fall into, as a new version; the others
stay where they are.  A version counts once Spark's committer has marked it as whole, so a reader sees all of a change
or nothing of it, and a failed write leaves the last state.  Changes are upserts and may be applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a store; a store's own number is that of its first version and must stay.
BUCKETS = 64


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(s.getPath().toString()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def _buckets(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The last whole version's number (0: none) and where each bucket's latest state lies."""
    whole = {int(p.rsplit("v=", 1)[1].split("/")[0]) for p in _listed(spark, f"{root}/v=*/_SUCCESS")}
    latest: dict[int, tuple[int, str]] = {}
    for p in _listed(spark, f"{root}/v=*/bucket=*"):
        version, bucket = int(p.rsplit("v=", 1)[1].split("/")[0]), int(p.rsplit("bucket=", 1)[1])
        if version in whole and version > latest.get(bucket, (0, ""))[0]:
            latest[bucket] = (version, p)
    return max(whole, default=0), {b: p for b, (_, p) in latest.items()}


def _read(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    held = T.StructType([*schema, T.StructField("_deleted", T.BooleanType())])
    return spark.read.schema(held).json(paths) if paths else spark.createDataFrame([], held)


def read_store(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The store's records as they stand; a store that was never written is empty."""
    kind = T._parse_datatype_string(schema)
    return _read(spark, [*_buckets(spark, root.rstrip("/"))[1].values()], kind).where("_deleted is not true").drop("_deleted")


def upsert(changes: DataFrame, root: str, key: str, order: str, deleted: str | None = None) -> int:
    """Applies changes and returns the new version's number; of several changes of one key the last by ``order`` counts.

    ``changes`` has the key, ``order`` and the record's columns; where ``deleted`` is true the record goes (its key stays behind as a mark, so
    that no bucket is ever without a file).  A change older than the record that is held does nothing.  Null keys are one record.
    """
    spark, root = changes.sparkSession, root.rstrip("/")
    gone = F.col(deleted) if deleted else F.lit(False)
    columns = [c for c in changes.columns if c != deleted]
    rows = changes.select(*columns, gone.alias("_deleted"))
    schema = T.StructType([f for f in rows.schema if f.name != "_deleted"])
    at = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    version, buckets = _buckets(spark, root)
    touched = [r[0] for r in rows.select(at.alias("b")).distinct().collect()]  # BUCKETS at most
    if not touched:
        return version
    held = _read(spark, [buckets[b] for b in touched if b in buckets], schema)
    both = held.select(rows.columns).unionByName(rows)
    last = both.groupBy(F.col(key)).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.col(order)).alias("r")).select(F.col(key), "r.*").select(rows.columns)
    last.withColumn("bucket", at).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(f"{root}/v={version + 1}")
    return version + 1


def upserts(stream: DataFrame, root: str, key: str, order: str, deleted: str | None = None):
    """A writer of a stream into the store: call ``start`` with a checkpoint folder.  A batch that comes again changes nothing."""

    def apply(rows: DataFrame, _: int) -> None:
        upsert(rows, root, key, order, deleted)

    return stream.writeStream.outputMode("append").foreachBatch(apply)
