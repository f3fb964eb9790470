"""Exact ranks within groups, from histograms of digits and without a sort of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm._store import discard, stored

#: Bits of one digit: a window holds 256 values at most.
BITS = 8
#: Rows that are equal throughout are dealt out so many at a time.
BLOCK = 65536
_SIGN = -(1 << 63)


def exact_ranks(rows: DataFrame, group: str | None, number: str | None, ties: list[str]) -> DataFrame:
    """``rows``, of the columns named here, with ``rank`` (from 0) in its group by ``number`` (null first), then ``ties``, and ``total``, the group's rows.

    ``group`` and ``ties`` are strings that aren't null.  Repeated rows get neighbouring ranks.  Counts of prefixes are summed level by level, the
    longest first; on the way back each prefix gets the counts of its smaller siblings, of which a level has 256.  Where one number has many rows,
    the leading bytes of the first tie are digits too.
    """
    key = [F.col(group) if group else F.lit("")]
    value = F.col(number).cast("long") if number else F.lit(0).cast("long")
    # Unsigned order of the flipped number is its order; a null is a digit of its own before all others.
    full = rows.groupBy(key[0].alias("g"), value.isNotNull().cast("int").alias("z"), F.coalesce(value.bitwiseXOR(F.lit(_SIGN)), F.lit(0).cast("long")).alias("p"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)))
    full = stored(full.agg(F.count("*").alias("n")))
    counts = stored(full.groupBy("g", "z", "p").agg(F.sum("n").alias("n"), F.count("*").alias("m")))
    known = counts.where("z = 1").agg(F.min(F.col("p").bitwiseXOR(F.lit(_SIGN))), F.max(F.col("p").bitwiseXOR(F.lit(_SIGN)))).first()
    most = counts.agg(F.max("m")).first()[0] or 0
    varying = 0 if known[0] is None else ((known[0] ^ known[1]) & ((1 << 64) - 1)).bit_length()
    levels = [counts.select("g", "z", "p", "n")]
    for _ in range(-(-varying // BITS)):
        below = levels[-1]
        levels.append(below.groupBy("g", "z", F.shiftrightunsigned("p", BITS).alias("p")).agg(F.sum("n").alias("n")))
    whole = W.partitionBy("g")
    first = whole.orderBy("z", "p").rowsBetween(W.unboundedPreceding, -1)
    starts = levels.pop().select("g", "z", "p", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"))

    def down(below: DataFrame, parent: dict, order: list[str], starts: DataFrame) -> DataFrame:
        """``below`` with its starts: those of the parent and the counts of smaller siblings."""
        smaller = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        own = below.withColumns(parent).withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        above = starts.select(*(F.col(c).alias(f"{c}_up") if f"{c}_up" in parent else F.col(c) for c in starts.columns if c in ("g", "z", "p", "q")), "start", "total")
        return own.join(above, list(parent)).withColumn("start", F.col("start") + F.col("before")).drop("before", *(c for c in parent if c.endswith("_up")))

    for below in reversed(levels):
        starts = down(below, {"g": F.col("g"), "z": F.col("z"), "p_up": F.shiftrightunsigned("p", BITS)}, ["p"], starts).select("g", "z", "p", "start", "total")
    prefix = lambda k: F.hex(F.substring(F.col("t0").cast("binary"), 1, 2 * k))
    deep = 0
    while ties and 256 ** (deep + 1) < most:
        deep += 1
        cut = full.groupBy("g", "z", "p", prefix(deep).alias("q")).agg(F.sum("n").alias("n"))
        parent = {"g": F.col("g"), "z": F.col("z"), "p": F.col("p")} | ({"q_up": F.substring("q", 1, 4 * (deep - 1))} if deep > 1 else {})
        starts = down(cut, parent, ["q"], starts).select("g", "z", "p", "q", "start", "total")
    parent = {"g": F.col("g"), "z": F.col("z"), "p": F.col("p")} | ({"q": prefix(deep)} if deep else {})
    out = down(full, parent, [f"t{i}" for i in range(len(ties))] or ["p"], starts)
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    ranks = F.sequence(F.col("start") + F.col("block"), F.col("start") + F.least(F.col("block") + BLOCK, F.col("n")) - 1)
    named = ([F.col("g").alias(group)] if group else []) + ([F.when(F.col("z") == 1, F.col("p").bitwiseXOR(F.lit(_SIGN))).alias(number)] if number else [])
    out = out.select(*named, *(F.col(f"t{i}").alias(t) for i, t in enumerate(ties)), F.explode(ranks).alias("rank"), "total")
    out = stored(out)
    discard(full, counts)
    return out
