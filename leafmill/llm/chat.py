"""Chat formatting of reply trees, in DataFrame operations only.

Messages are nodes with a parent.  Self-joins on the parent pointer, each of which doubles the
distance that a pointer spans, give every node's depth and the score of its path from the
root, and then enumerate the nodes of the chosen leaves' paths: rounds grow with
the logarithm of the longest path, and no path is copied on the way.
Branches are ranked by score and each chosen one is formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line feed becomes ``\\n``), so no control string
can stand there and the original is restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm._store import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    if role:  # a line feed's n follows an odd backslash; doubled ones are kept apart meanwhile
        marked = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
        return F.replace(F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """Pointers ``(tree, node, anc, hops, sum)`` over 1, 2, 4... steps up, until none is left; the last has every node's depth and path score."""
    at = stored(nodes.select("tree", "node", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.coalesce("score", F.lit(0.0)).alias("sum")))
    levels = [at]
    while not at.where("anc is not null").isEmpty():
        up = at.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("anc").alias("_anc"), F.col("hops").alias("_hops"), F.col("sum").alias("_sum"))
        on = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("anc") == F.col("_n"))
        moved = at.where("anc is not null").join(up, on).select("tree", "node", F.col("_anc").alias("anc"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("sum") + F.col("_sum")).alias("sum"))
        at = stored(moved.union(at.where("anc is null")))  # what has reached its root isn't joined again
        levels.append(at)
        if len(levels) > 40:
            raise ValueError("the parents form a cycle")
    return levels


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Rows ``(tree, leaf, rank, path_score, node, depth)``: the ``branches`` best root-to-leaf paths of each tree.

    ``messages`` has ``tree``, ``node`` (unique in its tree, not null), ``parent`` (null: a root) and ``score``
    (null: 0).  A path's score is its messages' sum; ties go to the smaller leaf.  A parent that the tree lacks
    makes its child a root.  A cycle raises an error.
    """
    known = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    nodes = messages.select("tree", "node", "parent", "score").join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    nodes = stored(nodes.select("tree", "node", F.col("_n").alias("parent"), "score"))
    levels = _doubled(nodes)
    inner = nodes.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = levels[-1].join(inner, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("sum"), "node"))).where(F.col("rank") <= branches)
    chosen = ranked.select("tree", F.col("node").alias("leaf"), "rank", F.col("sum").alias("path_score"), "node", F.col("hops").alias("depth"))
    # A path's nodes so far, and those as many steps further up.
    for step, level in enumerate(levels[:-1]):
        up = level.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("anc").alias("_anc"))
        above = chosen.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).where("_anc is not null")
        above = above.select("tree", "leaf", "rank", "path_score", F.col("_anc").alias("node"), (F.col("depth") - F.lit(1 << step)).alias("depth"))
        chosen = stored(chosen.union(above))
    return chosen


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each path: ``(tree, leaf, rank, path_score, text, loss_spans)``.

    ``text`` is the formatted conversation and ``loss_spans`` the places of its assistants' escaped texts, as code points
    ``start, end`` (end exclusive).  ``messages`` also has ``role`` and ``content``; null counts as empty.
    """
    parts = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), escape(F.col("role"), role=True).alias("role"), escape(F.col("content")).alias("content"))
    turns = chosen.join(parts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    turns = turns.select("tree", "leaf", "rank", "path_score", F.struct("depth", "role", "content").alias("turn"))
    # A conversation is one text, so its turns meet in one row.
    whole = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.content, F.lit(END))), "")
    head, tail = len(START) + 1, len(END)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + F.length(t.role) + F.length(t.content) + head + tail).alias("at"),
            F.when(
                t.role == "assistant",
                F.array_append(
                    acc.spans,
                    F.struct((acc.at + F.length(t.role) + head).cast("long").alias("start"), (acc.at + F.length(t.role) + head + F.length(t.content)).cast("long").alias("end")),
                ),
            ).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return whole.select("tree", "leaf", "rank", "path_score", text.alias("text"), spans.alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        return F.struct(unescape(F.substring_index(body, "\n", 1), role=True).alias("role"), unescape(F.substr(body, F.locate("\n", body) + 1)).alias("text"))

    return F.transform(pieces, one)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def conversations(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations ``(conv_id, turn, role, text)``: each row replies to the one before it by turn.

    Rows with equal turns follow each other by role, then text, so all rows are kept; equal rows repeat.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(0.0).alias("score"), "role", F.col("text").alias("content"))
