"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.scratch import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The copy survives lost executors, is never recomputed, and gives the
    planner true sizes.  Shuffle files of the write go when it ends.  The table stays until
    :func:`discard`, or until the cluster cleans the folder like any checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafmill/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark: SparkSession = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
