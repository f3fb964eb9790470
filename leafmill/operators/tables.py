"""Tables on pages: ruled grids, lines on shared columns, stacked boxes; and boxes for tables that only text shows.

A page is a group of rows with equal ``keys``. Lines have ``keys, line_seq, text, x, y, width, height, baseline``, boxes have
``keys, box_seq, x, y, width, height, stroke, fill``. Edges and rows of a page are small arrays, found by grouping; lines and
boxes are placed between them by expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import trim_ws
from leafmill.operators.layout import anchor_groups, chain_clusters
from leafmill.sources.scratch import stored

#: Tolerances and sizes, in points.
RULE_LENGTH, RULE_HEIGHT, RULE_THICKNESS, RULES = 100.0, 20.0, 3.0, 3
EDGE, COLUMN, INDENT, JOINED = 3.0, 14.0, 12.0, 2.0
LEAST_WIDTH, LEAST_HEIGHT, OUTSIDE, ON_RULE, PAST_RULE = 10.0, 5.0, 2.0, 3.0, 2.0
SPAN, SPAN_STEP = 10.0, 3.0
ROW_WIDTH, ROW_HEIGHTS, ROW_X, ROW_W, ROW_GAPS, SLIVER = 40.0, (12.0, 80.0), 2.0, 4.0, (-1.0, 8.0), 18.0
LOOK_AHEAD, HEADER_GAP = 8, 3.2

CELL = ("strategy", "table_seq", "row", "col", "row_span", "col_span", "x", "y", "width", "height", "text", "fill", "table_x", "table_y", "table_width", "table_height")


def _edges(values: DataFrame, keys: list[str], value: str, tol: float, name: str) -> DataFrame:
    """``keys, name``: the sorted means of each page's clustered values."""
    return chain_clusters(values, keys, value, tol).groupBy(*keys).agg(F.array_sort(F.collect_list("mean")).alias(name))


def _slot(edges: Column, value: Column, slack: float) -> Column:
    """Between which edges a value lies, from ``slack`` before the first to half a point before the second; the last slot for what fits none."""
    last = F.size(edges) - 2
    fits = F.filter(F.sequence(F.lit(0), last), lambda k: (F.get(edges, k) - slack <= value) & (value < F.get(edges, k + 1) - 0.5))
    return F.coalesce(F.array_min(fits), last)


def _span_end(edges: Column, value: Column, start: Column) -> Column:
    """The last edge near a value that is at least two on from ``start`` and well past its neighbour; the next one if none is."""
    near = F.filter(F.sequence(F.lit(0), F.size(edges) - 1), lambda e: (e >= start + 2) & (F.abs(value - F.get(edges, e)) <= SPAN) & (value >= F.get(edges, e - 1) + SPAN_STEP))
    return F.coalesce(F.array_max(near), start + 1)


def _closest(edges: Column, value: Column, skip_first: bool) -> Column:
    """The index of the edge nearest to a value, the first of equals; the last edge or the first is left out."""
    ranked = F.transform(edges, lambda e, i: F.struct(F.abs(e - value).alias("d"), i.alias("i")))
    return F.array_min(F.slice(ranked, F.lit(1 + skip_first), F.size(edges) - 1)).i


def _steps(edges: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.get(edges, i + 1) - F.get(edges, i))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _stacked_text(order: str = "line_seq") -> Column:
    """An aggregate: texts in order, each put on a new line of what stands so far, trimmed."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s.text)
    return F.aggregate(F.slice(texts, F.lit(2), F.size(texts)), F.get(texts, F.lit(0)), lambda a, t: trim_ws(F.concat(a, F.lit("\n"), t)))


def _on(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def _empty_cells(grid: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``grid(keys, row, col, ...)`` that no cell's span covers."""
    down = cells.select(*keys, F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), "col", "col_span")
    covered = down.select(*keys, "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    return grid.join(covered, [*keys, "row", "col"], "left_anti")


def aligned_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The table that lines on shared baselines and column starts form: at least four lines, two rows and two columns."""
    n = lines.withColumn("_top", F.bround("baseline", 1)).withColumn("_left", F.bround("x", 1)).withColumn("_low", F.col("baseline") + F.col("height"))
    n = n.withColumn("row", F.dense_rank().over(W.partitionBy(*keys).orderBy("_top")) - 1)
    columns = _edges(n.select(*keys, "_left").distinct(), keys, "_left", COLUMN, "xs")
    rows = n.groupBy(*keys, "row").agg(F.min("_top").alias("top"), (F.max("_low") - F.min("baseline")).alias("tall"), F.max("_low").alias("low"), F.count("*").alias("n"), F.min("_left").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"))
    one = F.array_sort(F.collect_list(F.struct("row", "top", "tall")))
    pages = rows.groupBy(*keys).agg(one.alias("rows"), F.max("low").alias("low"), F.sum("n").alias("n"), F.min("left").alias("table_x"), F.max("right").alias("right")).where((F.col("n") >= 4) & (F.size("rows") >= 2))
    pages = pages.join(columns, keys).where(F.size("xs") >= 3)
    pages = pages.select(
        *keys, "xs", F.concat(F.transform("rows", lambda r: r.top), F.array("low")).alias("ys"), F.transform("rows", lambda r: r.tall).alias("talls"),
        "table_x", F.get("rows", F.lit(0)).top.alias("table_y"), (F.col("right") - F.col("table_x")).alias("table_width"), (F.col("low") - F.get("rows", F.lit(0)).top).alias("table_height"),
    )
    at = n.join(pages, keys).withColumn("col", _slot(F.col("xs"), F.col("x") + 0.1, 2.0))
    at = at.withColumn("_right", _span_end(F.col("xs"), F.col("x") + F.col("width"), F.col("col"))).withColumn("_cols", F.collect_set("col").over(W.partitionBy(*keys, "row")))
    at = at.withColumn("_right", F.when(F.exists("_cols", lambda o: (o > F.col("col")) & (o < F.col("_right"))), F.col("col") + 1).otherwise(F.col("_right")))
    at = at.withColumn("_end", _span_end(F.col("ys"), F.col("_low"), F.col("row")))
    found = at.groupBy(*keys, "row", "col").agg(F.min_by(F.struct((F.col("_end") - F.col("row")).alias("row_span"), (F.col("_right") - F.col("col")).alias("col_span")), "line_seq").alias("s"), _stacked_text().alias("text"))
    found = found.select(*keys, "row", "col", "s.*", "text")
    size = pages.select(*keys, F.explode(F.sequence(F.lit(0), F.size("talls") - 1)).alias("row"), (F.size("xs") - 2).alias("_last"))
    grid = size.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("col"))
    blank = _empty_cells(grid, found, keys).select(*keys, "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("").alias("text"))
    cells = found.union(blank).join(pages, keys)
    return cells.select(
        *keys, F.lit("lines").alias("strategy"), F.lit(0).alias("table_seq"), "row", "col", "row_span", "col_span", F.get("xs", "col").alias("x"), F.get("ys", "row").alias("y"),
        (F.get("xs", F.col("col") + F.col("col_span")) - F.get("xs", "col")).alias("width"), _sum(F.slice("talls", F.col("row") + 1, F.col("row_span"))).alias("height"), "text", F.lit(None).cast("string").alias("fill"),
        "table_x", "table_y", "table_width", "table_height",
    )


def _text_inside(cells: DataFrame, lines: DataFrame, keys: list[str], cell_keys: list[str]) -> DataFrame:
    """``cells`` with ``text``: trimmed lines with their middle across and their baseline inside, from top to bottom."""
    c, n = cells.alias("c"), lines.withColumn("text", trim_ws(F.col("text"))).where("text <> ''").alias("n")
    middle = F.col("n.x") + F.col("n.width") / 2
    held = middle.between(F.col("c.x") - 1, F.col("c.x") + F.col("c.width") + 1) & F.col("n.baseline").between(F.col("c.y") - 1, F.col("c.y") + F.col("c.height") + 1)
    pairs = c.join(n, _on("c", "n", keys) & held).select(*(F.col(f"c.{k}").alias(k) for k in [*keys, *cell_keys]), F.struct("n.baseline", "n.x", "n.line_seq", "n.text").alias("s"))
    texts = pairs.groupBy(*keys, *cell_keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.text), "\n").alias("text"))
    return cells.join(texts, [*keys, *cell_keys], "left").withColumn("text", F.coalesce("text", F.lit("")))


def ruled_tables(boxes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The table that ruling lines draw. Filled boxes are its cells; without any, grid cells that no rule parts are one."""
    ruling = F.coalesce(F.col("stroke"), F.lit("")) != ""
    flat = boxes.where(ruling & (F.col("width") >= RULE_LENGTH) & (F.col("height") <= RULE_THICKNESS))
    tall = boxes.where(ruling & (F.col("height") >= RULE_HEIGHT) & (F.col("width") <= RULE_THICKNESS))
    ends = lambda b, at, size: b.select(*keys, F.explode(F.array(F.col(at), F.col(at) + F.col(size))).alias("v"))
    rules = lambda b, name: b.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias(name)).where(F.size(name) >= RULES)
    pages = _edges(ends(tall, "x", "width"), keys, "v", EDGE, "xs").join(_edges(ends(flat, "y", "height"), keys, "v", EDGE, "ys"), keys)
    pages = pages.where((F.size("xs") >= 2) & (F.size("ys") >= 2)).join(rules(flat, "flat"), keys).join(rules(tall, "tall"), keys)
    pages = pages.where(F.forall(_steps(F.col("xs")), lambda s: s >= LEAST_WIDTH) & F.forall(_steps(F.col("ys")), lambda s: s >= LEAST_HEIGHT))
    left, right, top, low = F.get("xs", F.lit(0)), F.element_at("xs", -1), F.get("ys", F.lit(0)), F.element_at("ys", -1)

    b = boxes.where(F.coalesce(F.col("fill"), F.lit("")) != "").join(pages, keys)
    filled = b.where((F.col("x") >= left - OUTSIDE) & (F.col("y") >= top - OUTSIDE) & (F.col("x") + F.col("width") <= right + OUTSIDE) & (F.col("y") + F.col("height") <= low + OUTSIDE))
    row, col = _closest(F.col("ys"), F.col("y"), False), _closest(F.col("xs"), F.col("x"), False)
    filled = filled.withColumns({"row": row, "col": col, "_end": _closest(F.col("ys"), F.col("y") + F.col("height"), True), "_right": _closest(F.col("xs"), F.col("x") + F.col("width"), True)})
    filled = filled.select(*keys, F.col("box_seq").alias("_cell"), "row", "col", F.greatest(F.lit(1), F.col("_end") - F.col("row")).alias("row_span"), F.greatest(F.lit(1), F.col("_right") - F.col("col")).alias("col_span"), "x", "y", "width", "height", "fill")

    # Unfilled grids: cells are numbered row by row, and each pair of neighbours without a rule between them takes one number.
    bare = pages.join(filled.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.size("xs") - 1)
    across, down = F.sequence(F.lit(0), F.col("_n") - 1), F.sequence(F.lit(0), F.size("ys") - 2)

    def parted(rules_: str, at: str, thick: str, along: str, length: str, edge: Column, a: Column, z: Column) -> Column:
        return F.exists(rules_, lambda q: (F.abs(q[at] + q[thick] / 2 - edge) <= ON_RULE) & (q[along] <= a + PAST_RULE) & (q[along] + q[length] >= z - PAST_RULE))

    xs, ys = (lambda i: F.get("xs", i)), (lambda i: F.get("ys", i))
    open_right = lambda r, c: (c + 1 < F.col("_n")) & ~parted("tall", "x", "width", "y", "height", xs(c + 1), ys(r), ys(r + 1))
    open_below = lambda r, c: (r + 2 < F.size("ys")) & ~parted("flat", "y", "height", "x", "width", ys(r + 1), xs(c), xs(c + 1))
    number = lambda r, c: r * F.col("_n") + c
    pair = lambda a, z: F.struct(a.alias("a"), z.alias("z"))
    ways: Callable[[Column, Column], Column] = lambda r, c: F.array(F.when(open_right(r, c), pair(number(r, c), number(r, c + 1))), F.when(open_below(r, c), pair(number(r, c), number(r + 1, c))))
    links = F.filter(F.flatten(F.flatten(F.transform(down, lambda r: F.transform(across, lambda c: ways(r, c))))), lambda e: e.isNotNull())
    alone = F.sequence(F.lit(0), (F.size("ys") - 1) * F.col("_n") - 1)
    names = F.aggregate(links, alone, lambda held, e: F.transform(held, lambda v: F.when(v == F.get(held, e.z), F.get(held, e.a)).otherwise(v)))
    split = bare.select(*keys, "xs", "ys", "_n", F.posexplode(names).alias("_i", "_cell"))
    r, c = F.floor(F.col("_i") / F.col("_n")).cast("int"), (F.col("_i") % F.col("_n")).cast("int")
    whole = split.groupBy(*keys, "_cell").agg(F.first("xs").alias("xs"), F.first("ys").alias("ys"), F.min(r).alias("row"), F.min(c).alias("col"), (F.max(r) - F.min(r) + 1).alias("row_span"), (F.max(c) - F.min(c) + 1).alias("col_span"))
    x, y = F.get("xs", "col"), F.get("ys", "row")
    whole = whole.select(*keys, "_cell", "row", "col", "row_span", "col_span", x.alias("x"), y.alias("y"), (F.get("xs", F.col("col") + F.col("col_span")) - x).alias("width"), (F.get("ys", F.col("row") + F.col("row_span")) - y).alias("height"), F.lit(None).cast("string").alias("fill"))

    cells = _text_inside(filled.union(whole), lines, keys, ["_cell"])
    used = filled.groupBy(*keys).agg(F.max(F.col("row") + F.col("row_span")).alias("_used"))
    extent = pages.join(used, keys, "left").select(*keys, left.alias("table_x"), top.alias("table_y"), (right - left).alias("table_width"), (F.coalesce(F.get("ys", "_used"), low) - top).alias("table_height"))
    return cells.join(extent, keys).select(*keys, F.lit("grid").alias("strategy"), F.lit(0).alias("table_seq"), *CELL[2:])


def stacked_tables(boxes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Tables of boxes of equal left side and width that lie under each other; columns where texts inside start.

    From top to bottom a box joins the first stack that it continues, else it begins one; stacks of one box are no tables.
    """
    fits = (F.col("width") >= ROW_WIDTH) & F.col("height").between(*ROW_HEIGHTS)
    one = F.struct("y", "x", "box_seq", "width", "height")
    page = boxes.where(fits).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("b"))
    start = F.from_json(F.lit("[]"), "array<struct<x:double,width:double,low:double,seqs:array<bigint>>>")

    def place(stacks: Column, b: Column) -> Column:
        goes_on = lambda s: (F.abs(b.x - s.x) <= ROW_X) & (F.abs(b.width - s.width) <= ROW_W) & (b.y - s.low).between(*ROW_GAPS)
        at = F.array_min(F.filter(F.transform(stacks, lambda s, i: F.when(goes_on(s), i)), lambda i: i.isNotNull()))
        low, seq = (b.y + b.height).alias("low"), b.box_seq.cast("long")
        longer = F.transform(stacks, lambda s, i: F.when(i == at, F.struct(s.x.alias("x"), s.width.alias("width"), low, F.array_append(s.seqs, seq).alias("seqs"))).otherwise(s))
        return F.when(at.isNotNull(), longer).otherwise(F.array_append(stacks, F.struct(b.x.alias("x"), b.width.alias("width"), low, F.array(seq).alias("seqs"))))

    stacks = F.filter(F.aggregate("b", start, place), lambda s: F.size(s.seqs) > 1)
    members = page.select(*keys, F.posexplode(stacks).alias("_stack", "s")).select(*keys, "_stack", F.posexplode("s.seqs").alias("row", "box_seq"))
    rows = members.join(boxes, [*keys, "box_seq"])
    mine = [*keys, "_stack"]
    right, low = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    frames = rows.groupBy(*mine).agg(
        F.min("x").alias("table_x"), F.min("y").alias("table_y"), (F.max(right) - F.min("x")).alias("table_width"), (F.max(low) - F.min("y")).alias("table_height"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "height"))), lambda r: r.height).alias("talls"), F.transform(F.array_sort(F.collect_list(F.struct("row", "fill"))), lambda r: r.fill).alias("fills"),
    )
    f, n = frames.alias("f"), lines.alias("n")
    end = lambda at, size: F.col(f"f.{at}") + F.col(f"f.{size}")
    within = (F.col("n.x") + F.col("n.width") / 2).between(F.col("f.table_x") - 1, end("table_x", "table_width") + 1) & F.col("n.baseline").between(F.col("f.table_y") - 1, end("table_y", "table_height") + 1)
    held = f.join(n, _on("f", "n", keys) & within).select("f.*", "n.line_seq", "n.text", "n.x", "n.baseline")
    starts = _edges(held.select(*mine, "x"), mine, "x", INDENT, "starts")
    outer = F.col("table_x"), F.col("table_x") + F.col("table_width")
    marks = starts.join(frames, mine).select(*mine, F.explode(F.concat(F.array(outer[0]), F.slice("starts", F.lit(2), F.size("starts")), F.array(outer[1]))).alias("v"))
    edges = _edges(marks, mine, "v", JOINED, "e").join(frames, mine)
    edges = edges.withColumn("e", F.when(F.element_at("e", -1) < outer[1] - 1, F.array_append("e", outer[1])).otherwise(F.col("e")))
    inner = lambda keep: F.filter(F.slice("e", F.lit(2), F.size("e") - 2), keep)
    first, last = F.get("e", F.lit(0)), F.element_at("e", -1)
    edges = edges.withColumn("e", F.concat(F.array(first), inner(lambda v: v - first >= SLIVER), F.array(last)))
    edges = edges.withColumn("e", F.concat(F.array(first), inner(lambda v: last - v >= SLIVER), F.array(last)))
    tops = F.transform(F.sequence(F.lit(0), F.size("talls")), lambda i: F.col("table_y") + _sum(F.slice("talls", F.lit(1), i)))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("_stack")) - 1  # stacks without any text aren't counted
    edges = edges.withColumn("ys", tops).withColumn("table_seq", number)
    at = held.join(edges.select(*mine, "e", "ys"), mine)
    row = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.size("ys") - 2), lambda k: F.col("baseline") < F.get("ys", k + 1) + 0.5)), F.size("ys") - 2)
    texts = at.withColumn("row", row).withColumn("col", _slot(F.col("e"), F.col("x") + 0.1, 1.0)).groupBy(*mine, "row", "col").agg(_stacked_text().alias("text"))
    grid = edges.withColumn("row", F.explode(F.sequence(F.lit(0), F.size("talls") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.size("e") - 2)))
    cells = grid.join(texts, [*mine, "row", "col"], "left")
    return cells.select(
        *keys, F.lit("stacked").alias("strategy"), "table_seq", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.get("e", "col").alias("x"), F.get("ys", "row").alias("y"),
        (F.get("e", F.col("col") + 1) - F.get("e", "col")).alias("width"), F.get("talls", "row").alias("height"), F.coalesce("text", F.lit("")).alias("text"), F.get("fills", "row").alias("fill"),
        "table_x", "table_y", "table_width", "table_height",
    )


def tables(boxes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Table cells of each page: ruled grids before aligned lines before stacked boxes, the first that finds any on the page.

    What a strategy finds is written once: the pages that it leaves are the next one's.
    """
    grids = stored(ruled_tables(boxes, lines, keys))
    rest = lambda df, found: df.join(found.select(*keys).distinct(), keys, "left_anti")
    by_lines = stored(aligned_tables(rest(lines, grids), keys))
    stacked = stacked_tables(rest(rest(boxes, grids), by_lines), lines, keys)
    return grids.unionByName(by_lines).unionByName(stacked)


def inferred_boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Table boxes ``keys, box_seq, x, y, width, height`` where only text shows a table: under a row of several lines, the next rows.

    Of the header and the seven rows after it, those that lie less than 3.2 header heights under the row before them make a grid between the
    header's columns; the search goes on after as many rows as the grid has.
    """
    rows = anchor_groups(lines, keys).groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("x", "y", "line_seq", "width", "height", "text"))).alias("n"))
    rows = rows.where(F.exists("n", lambda s: trim_ws(s.text) != ""))
    head = F.get("n", F.lit(0))
    one = F.struct(
        head.y.alias("y"), "row", head.height.alias("height"), F.transform("n", lambda s: F.struct(s.x.alias("x"), s.width.alias("width"))).alias("n"), F.array_max(F.transform("n", lambda s: s.height)).alias("tall"),
        F.array_max(F.transform("n", lambda s: s.x + s.width)).alias("right"), F.array_max(F.transform("n", lambda s: s.y + s.height)).alias("low"),
    )
    page = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    at = page.select(*keys, "rows", F.posexplode("rows").alias("i", "h")).withColumn("view", F.slice("rows", F.col("i") + 1, LOOK_AHEAD))
    step = lambda r, k: r.y - F.get("view", k - 1).y
    at = at.withColumn("near", F.filter("view", lambda r, k: (k == 0) | ((step(r, k) > 0) & (step(r, k) < F.col("h.tall") * HEADER_GAP))))
    pad_x, pad_y = F.greatest(F.lit(5.0), F.col("h.tall") * 0.35), F.greatest(F.lit(4.0), F.col("h.tall") * 0.25)
    n, last = F.col("h.n"), F.size("h.n") - 1
    between = F.transform(F.slice(n, F.lit(1), last), lambda s, c: (s.x + s.width + F.get(n, c + 1).x) / 2)
    xs = F.concat(F.array(F.greatest(F.lit(0.0), F.get(n, F.lit(0)).x - pad_x)), between, F.array(F.array_max(F.transform("near", lambda r: r.right)) + pad_x))
    near = F.col("near")
    middles = F.transform(F.slice(near, F.lit(1), F.size(near) - 1), lambda r, k: (r.y + r.height + F.get(near, k + 1).y) / 2)
    ys = F.concat(F.array(F.greatest(F.lit(0.0), F.get(near, F.lit(0)).y - pad_y)), middles, F.array(F.element_at(near, -1).low + pad_y))
    at = at.where((F.size("h.n") >= 2) & (F.size("near") >= 2)).select(*keys, "i", xs.alias("xs"), ys.alias("ys"), F.size("near").alias("k"))
    at = at.where(F.forall(_steps(F.col("xs")), lambda s: s > 0))
    # Headers in order; one that lies among the rows of a grid before it is none.
    found = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "k", "xs", "ys"))).alias("g"))
    free = F.aggregate("g", F.struct(F.lit(0).alias("to"), F.from_json(F.lit("[]"), "array<int>").alias("i")), lambda a, g: F.when(g.i >= a.to, F.struct((g.i + g.k).alias("to"), F.array_append(a.i, g.i).alias("i"))).otherwise(a)).i
    grids = found.withColumn("free", free).select(*keys, F.explode(F.filter("g", lambda g: F.array_contains("free", g.i))).alias("g")).select(*keys, "g.i", "g.xs", "g.ys")
    cells = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.size("ys") - 2))).withColumn("c", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)))
    x, y = F.get("xs", "c"), F.get("ys", "r")
    seq = (F.row_number().over(W.partitionBy(*keys).orderBy("i", "r", "c")) - 1).alias("box_seq")
    return cells.select(*keys, seq, x.alias("x"), y.alias("y"), (F.get("xs", F.col("c") + 1) - x).alias("width"), (F.get("ys", F.col("r") + 1) - y).alias("height"))
