"""Keyed state that the engine ends by the watermark: idempotent deliveries and daily counts.

Each takes a streaming DataFrame and returns one; the caller chooses the sink and the
checkpoint folder, from which a lost query resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 3


def first_deliveries(events: DataFrame, key: str, at: str, bound: str | None = "30 days") -> DataFrame:
    """Each delivery key once. The state holds the keys of the last ``bound`` of event time; without a bound it keeps all keys ever seen."""
    if bound is None:
        return events.dropDuplicates([key])
    return events.withWatermark(at, bound).dropDuplicatesWithinWatermark([key])


def daily_uses(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Uses of each key and UTC day, up to date; days behind the watermark are dropped from the state."""
    n = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), key).agg(F.count("*").alias("n"))
    return n.select(key, F.to_date("window.start").alias("day"), "n", F.least("n", F.lit(LIMIT)).alias("used"), F.greatest(F.lit(0), LIMIT - F.col("n")).alias("remaining"))
