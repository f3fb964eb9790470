"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed in cells of source, language and topic.  Each sweep rescales the cells'
weights so that one marginal after the other meets its target; the fitted weights give each cell a
sampling probability, and a document stays if a hash of its id falls below it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm._store import stored

DIMS = ("source", "lang", "topic")
TOKEN = r"[^\x09-\x0D\x20]+"


def topic_of(text: Column) -> Column:
    """A document's topic by its form: empty, list, noisy, shouted, contact or prose; the first that applies."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(text.contains(" | "), "list")
        .when(text.contains("###") | text.contains("$$$") | text.contains("%%%") | text.contains("&&&") | text.contains("***"), "noisy")
        .when(text.contains("!!") & text.rlike("[A-Z]!!"), "shouted")
        .when(text.contains("@") & text.rlike("[0-9A-Za-z]@[0-9A-Za-z]"), "contact")
        .otherwise("prose")
    )


def draw(id_: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens of each (source, lang, topic), nulls as the word ``unknown``; from columns of these names and ``tokens``."""
    return docs.groupBy(*(F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in DIMS)).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], sweeps: int = 8) -> DataFrame:
    """``cells`` with ``weight``, summing to 1, whose marginals approach the targets.

    A target is a mapping from value to share (values that the cells lack are left out,
    unnamed values keep their own share, and shares are rescaled to 1), or a number ``t``: shares in
    proportion to the tokens' power ``t`` (1 as they are, 0 uniform over values).
    """
    w = cells
    for d in DIMS:
        goal = targets.get(d, 1.0)
        own = F.sum("tokens").over(W.partitionBy(d))
        if isinstance(goal, Mapping):
            named = F.coalesce(*(F.when(F.col(d) == k, F.lit(float(v))) for k, v in goal.items()), own / F.sum("tokens").over(W.partitionBy()))
        else:
            named = F.pow(own, F.lit(float(goal)))
        w = w.withColumn(f"_goal_{d}", named).withColumn(f"_first_{d}", F.row_number().over(W.partitionBy(d).orderBy(*DIMS)) == 1)
        w = w.withColumn(f"_goal_{d}", F.col(f"_goal_{d}") / F.sum(F.when(F.col(f"_first_{d}"), F.col(f"_goal_{d}"))).over(W.partitionBy()))
    w = w.withColumn("weight", F.col("tokens") / F.sum("tokens").over(W.partitionBy()))
    for _ in range(sweeps):
        for d in DIMS:
            w = w.withColumn("weight", F.col("weight") * F.col(f"_goal_{d}") / F.sum("weight").over(W.partitionBy(d)))
    return w.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy())).select(*DIMS, "tokens", "weight")


def residuals(cells: DataFrame, fitted: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> DataFrame:
    """Rows ``(dim, value, target, share)``: the target of every value of each marginal and the weight that it has in ``fitted``.

    They agree for the marginal that was fitted last; for the others they tell how far the sweeps are from the end.
    """
    parts = []
    for d in DIMS:
        goal = targets.get(d, 1.0)
        own = cells.groupBy(d).agg(F.sum("tokens").alias("own"))
        everything = F.sum("own").over(W.partitionBy())
        if isinstance(goal, Mapping):
            named = F.coalesce(*(F.when(F.col(d) == k, F.lit(float(v))) for k, v in goal.items()), F.col("own") / everything)
        else:
            named = F.pow("own", F.lit(float(goal)))
        own = own.withColumn("target", named).withColumn("target", F.col("target") / F.sum("target").over(W.partitionBy()))
        have = fitted.groupBy(d).agg(F.sum("weight").alias("share"))
        parts.append(own.join(have, d).select(F.lit(d).alias("dim"), F.col(d).alias("value"), "target", "share"))
    return parts[0].union(parts[1]).union(parts[2])


def probabilities(fitted: DataFrame, keep: float) -> DataFrame:
    """``fitted`` with ``prob``: the chance of each document of a cell.

    Cells' chances are in proportion to weight over tokens, scaled so that the sample is expected
    to hold the share ``keep`` of all tokens; where that passes 1, the cell stays whole and
    the rest are scaled up in its place, until no other passes 1.
    """
    everything = F.sum("tokens").over(W.partitionBy())
    p = fitted.withColumn("_want", F.lit(keep) * everything).withColumn("_ratio", F.col("weight") / F.col("tokens"))
    # With the cells of higher ratio whole, each cell asks for a scale; it grows while cells pass 1 and falls after them, so the largest is the one.
    above = F.sum("tokens").over(W.orderBy(F.col("_ratio").desc(), *DIMS).rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("weight").over(W.orderBy("_ratio", *(F.col(d).desc() for d in DIMS)).rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_scale", F.greatest(F.lit(0.0), F.col("_want") - F.coalesce(above, F.lit(0.0))) / F.when(rest > 0, rest))
    p = p.withColumn("prob", F.coalesce(F.least(F.lit(1.0), F.max("_scale").over(W.partitionBy()) * F.col("_ratio")), F.lit(1.0)))
    return p.select(*DIMS, "tokens", "weight", "prob")


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | float] | None = None,
    keep: float = 0.7,
    seed: int = 17,
    sweeps: int = 8,
    id_col: str = "doc_id",
    text: str = "text",
    topic: Column | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs``' ``columns`` (all by default) with ``topic``, ``tokens``, ``weight``, ``prob`` and ``sampled``; every row is returned.

    ``docs`` needs ``source`` and ``lang``.  Null source, language or topic count as ``unknown``; a text
    that is null or has no token has no cell: weight null, prob 1 and sampled, as it takes no tokens.  Rows with
    equal ids are drawn alike, and so are rows with null ids.  Columns of the added names are replaced.  Default targets temper
    each marginal by the power 0.7.
    """
    targets = {d: 0.7 for d in DIMS} if targets is None else targets
    added = ["topic", "tokens", "weight", "prob", "sampled"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in added]
    marked = docs.select(
        *columns,
        F.coalesce(F.col("source"), F.lit("unknown")).alias("__mix_source"),
        F.coalesce(F.col("lang"), F.lit("unknown")).alias("__mix_lang"),
        F.coalesce(topic_of(F.col(text)) if topic is None else topic, F.lit("unknown")).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"),
        draw(F.col(id_col), seed).alias("__mix_draw"),
    )
    wide = marked.select("__mix_source", "__mix_lang", "topic", "tokens").withColumnsRenamed({"__mix_source": "source", "__mix_lang": "lang"})
    # Cells are statistics, a row for each combination that occurs: they don't grow with the documents, and are fitted together.
    fitted = probabilities(rake(stored(cells_of(wide)).repartition(1), targets, sweeps), keep)
    fitted = stored(fitted.select(F.col("source").alias("__mix_source"), F.col("lang").alias("__mix_lang"), "topic", "weight", "prob"))
    out = marked.join(fitted, ["__mix_source", "__mix_lang", "topic"], "left")
    prob = F.coalesce("prob", F.lit(1.0))
    return out.select(*columns, "topic", "tokens", "weight", prob.alias("prob"), F.coalesce(F.col("__mix_draw") < prob, F.lit(True)).alias("sampled"))


def mix_sql(keep: float = 0.7, seed: int = 17, sweeps: int = 8, temper: float = 0.7) -> str:
    """DuckDB SQL for :func:`mix` of ``documents`` with every marginal tempered alike."""
    topic = r"""CASE WHEN coalesce(len(text), 0) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'list'
      WHEN regexp_matches(text, '(###|\$\$\$|%%%|&&&|\*\*\*)') THEN 'noisy' WHEN regexp_matches(text, '[A-Z]!!') THEN 'shouted'
      WHEN regexp_matches(text, '[0-9A-Za-z]@[0-9A-Za-z]') THEN 'contact' ELSE 'prose' END"""
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {topic} AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0) AS BIGINT) AS tokens,
  CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR))), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents)""",
        "c0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        *(f"g_{x} AS (SELECT {x}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS goal FROM c0 GROUP BY {x})" for x in DIMS),
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c0)",
    ]
    at = 0
    for _ in range(sweeps):
        for x in DIMS:
            steps.append(f"w{at + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * goal / sum(w.weight) OVER (PARTITION BY w.{x}) AS weight FROM w{at} w JOIN g_{x} USING ({x}))")
            at += 1
    steps.append(f"f AS (SELECT source, lang, topic, tokens, weight / sum(weight) OVER () AS weight FROM w{at})")
    steps += [
        f"p AS (SELECT *, {keep} * sum(tokens) OVER () AS want, weight / tokens AS ratio FROM f)",
        """s AS (SELECT *, greatest(0.0, want - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / nullif(sum(weight) OVER (ORDER BY ratio, source DESC, lang DESC, topic DESC ROWS UNBOUNDED PRECEDING), 0) AS scale FROM p)""",
        "q AS (SELECT *, coalesce(least(1.0, max(scale) OVER () * ratio), 1.0) AS prob FROM s)",
    ]
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT doc_id, topic, d.tokens, round(weight, 9) AS weight, round(coalesce(prob, 1.0), 6) AS prob, u < coalesce(prob, 1.0) AS sampled
FROM d LEFT JOIN q USING (source, lang, topic)"""
    )
