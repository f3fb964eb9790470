"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a part has, unless one key has more: rows made of its words or glyphs are sorted in a task's memory.
PART = 2_000_000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``, in any store that Spark can read."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def in_parts(rows: DataFrame, key: str, text: str, chars: int = PART) -> DataFrame:
    """``rows`` dealt by ``key`` into as many parts as their texts fill, so that a part's size doesn't grow with the input."""
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    return rows.repartition(total // chars + 1, key)
