"""A Merkle manifest of a table: leaves, group roots, one root, and a proof of every row.

Rows of a group ascend by id.  Their exact ranks come from histograms of the id's digits: counts by prefix, each level summed
from the one below, and the counts of smaller siblings added up on the way down.  No level looks at more than one digit's
values at a time, so nothing is sorted as a whole and no group, however large, meets in one task.

A rank's digits in base ``fanout`` are the key of its leaf in a trie.  A trie is reduced by its longest prefixes first: nodes that share
all but their last ``levels`` digits become one row, in which those levels are folded; the row's top is a leaf of the next, shorter trie.  On
the way back every row passes its own path to the rows below it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._ranks import exact_ranks
from leafmill.llm._store import discard, stored

#: Nodes that one row of the reduction may hold.
WIDE = 256
_SIBS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _levels(fanout: int) -> int:
    return next(k for k in range(1, 64) if fanout ** (k + 1) > max(WIDE, fanout))


def _run(nodes: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(nodes, (start + 1).cast("int"), count.cast("int")), "")


def _folded(nodes: DataFrame, fanout: int, base: int) -> DataFrame:
    """Rows ``(grp, n, idx, items, l0, l1...)``: what shares all but the last digits of its rank in one row, and the levels above it there.

    ``nodes`` has ``(grp, n, idx, item)`` with ``item.hash``; ``n`` is the number of the group's leaves, ``base`` how many levels lie below.
    """
    depth = _levels(fanout)
    wide = fanout**depth
    rows = nodes.select("grp", "n", F.expr(f"idx div {wide}L").alias("idx"), F.struct(F.expr(f"cast(idx % {wide}L as int)").alias("at"), "item").alias("entry"))
    out = rows.groupBy("grp", "idx").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("entry")).alias("items"))
    out = out.withColumn("l0", F.transform("items", lambda e: e["item"]["hash"]))
    for k in range(depth):
        below = F.col(f"l{k}")
        above = F.transform(F.sequence(F.lit(0), F.expr(f"(size(l{k}) - 1) div {fanout}")), lambda i: F.sha2(_run(below, i * fanout, F.lit(fanout)).cast("binary"), 256))
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > F.lit(float(fanout) ** (base + k)), above))
    return out


def _tops(rows: DataFrame, fanout: int) -> DataFrame:
    top = F.coalesce(*(F.col(f"l{k}") for k in range(_levels(fanout), -1, -1)))
    return rows.select("grp", "n", "idx", F.struct(F.element_at(top, 1).alias("hash")).alias("item"))


def _siblings(at: Column, fanout: int) -> Column:
    """Siblings of the node at place ``at``, level by level: what stands left and right of it in its run."""

    def level(k: int) -> Column:
        place = F.floor(at / F.lit(fanout**k))
        first = place - place % fanout
        nodes = F.col(f"l{k}")
        pair = F.struct(_run(nodes, first, place - first).alias("left"), _run(nodes, place + 1, first + fanout - 1 - place).alias("right"))
        return F.when(F.col(f"l{k + 1}").isNotNull(), pair)

    return F.filter(F.array(*(level(k) for k in range(_levels(fanout)))), lambda s: s.isNotNull())


def _tries(leaves: DataFrame, fanout: int, most: int) -> list[DataFrame]:
    """The stored rows of every round of reduction, the lowest first; the last has one row for each group.  ``most``: leaves of the largest group."""
    rounds, base = [], 0
    while True:
        rounds.append(stored(_folded(leaves, fanout, base)))
        base += _levels(fanout)
        if most <= fanout**base:
            return rounds
        leaves = _tops(rounds[-1], fanout)


def _paths(rounds: list[DataFrame], fanout: int, above: DataFrame) -> DataFrame:
    """Each lowest item with its siblings up to the root: rows ``(grp, subroot, root, item, sibs)``; ``above`` has ``(grp, subroot, root, upper)`` for every group."""
    paths = above.select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("i"), "subroot", "root", "upper")
    for rows in reversed(rounds):
        joined = rows.join(paths, (F.col("grp") == F.col("g")) & (F.col("idx") == F.col("i"))).drop("g", "i")
        wide = fanout ** _levels(fanout)
        place = lambda e: F.struct((F.col("idx") * wide + e["at"]).alias("i"), F.concat(_siblings(e["at"], fanout), "upper").alias("upper"), e["item"].alias("item"))  # noqa: B023, E731
        # Paths are made where the levels are; what is exploded holds one path each.
        paths = joined.select(F.col("grp").alias("g"), "subroot", "root", F.explode(F.transform("items", place)).alias("e")).select("g", "subroot", "root", "e.*")
    return paths.select(F.col("g").alias("grp"), "subroot", "root", "item", F.col("upper").alias("sibs"))


def folded(leaf: Column, sibs: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(sibs, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proof_digest(sibs: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(sibs, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """Rows ``(grp, id, leaf, extra, subroot, root, sibs)``, one for each of ``rows``, which have ``(grp, id, leaf, extra)``.

    ``grp`` is a string (null: a group of its own, before all others; groups are ordered bytewise), ``id`` an integer, ``leaf`` a lowercase hex digest
    and ``extra`` any string that belongs to the row.  In a group rows ascend by id, null first; rows of equal ids by leaf, then extra;
    rows that are equal throughout have neighbouring ranks, each with siblings of its own.  An empty input gives no rows.
    """
    if fanout < 2:
        raise ValueError("a node has two children at least")
    held = stored(rows.select(F.coalesce(F.concat(F.lit("+"), "grp"), F.lit("")).alias("grp"), F.col("id").cast("long").alias("id"), "leaf", "extra"))
    ranked = exact_ranks(held, "grp", "id", ["leaf", "extra"])
    leaves = ranked.select("grp", F.col("total").alias("n"), F.col("rank").alias("idx"), F.struct(F.col("leaf").alias("hash"), "id", "extra").alias("item"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds = _tries(leaves, fanout, most)
    tops = stored(_tops(rounds[-1], fanout).select("grp", F.col("item.hash").alias("subroot")))
    # The groups are the leaves of one more trie; their order is that of their bytes.
    groups = exact_ranks(tops, None, None, ["grp", "subroot"])
    heads = groups.select(F.lit("").alias("grp"), F.col("total").alias("n"), F.col("rank").alias("idx"), F.struct(F.col("subroot").alias("hash"), F.col("grp").alias("group")).alias("item"))
    upper = _tries(heads, fanout, tops.count())
    root = _tops(upper[-1], fanout).select("grp", F.col("item.hash").alias("root"), F.lit(None).cast("string").alias("subroot"), F.from_json(F.lit("[]"), _SIBS).alias("upper"))
    above = _paths(upper, fanout, root).select(F.col("item.group").alias("grp"), F.col("item.hash").alias("subroot"), "root", F.col("sibs").alias("upper"))
    out = _paths(rounds, fanout, stored(above))
    discard(held)
    group = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    return out.select(group.alias("grp"), F.col("item.id").alias("id"), F.col("item.hash").alias("leaf"), F.col("item.extra").alias("extra"), "subroot", "root", "sibs")


def row_digest(columns: list[Column]) -> Column:
    """The leaf of a row."""
    return digest(*map(encoded, columns))


