"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.sources.scratch import stored


def before(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over all rows that come earlier by ``order``, which tells rows apart.

    Rows are dealt by ranges of the order and written once with their range's number.  Ranges are few, so their totals are summed in one
    small window; inside a range the sum runs on.
    """
    ranged = rows.withColumn("__amount", amount.cast("long")).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged)
    totals = ranged.groupBy("__range").agg(F.sum("__amount").alias("__total"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum("__amount").over(inside), F.lit(0))
    return ranged.withColumn("__own", own).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__own")).drop("__amount", "__range", "__own", "__start")
