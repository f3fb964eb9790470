"""Structured documents out of positioned lines: texts, titles, spacing, spans and table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X


def page_text(items: DataFrame, doc: str, page: str, seq: str, text: str, between: str = "\n") -> DataFrame:
    """A document's text: items of a page joined by spaces in order, pages by ``between``."""
    pages = items.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(seq, text))).alias("i"))
    pages = pages.select(doc, page, F.array_join(F.transform("i", lambda x: x[text]), " ").alias("t"))
    docs = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "t"))).alias("p"))
    return docs.select(doc, F.array_join(F.transform("p", lambda x: x.t), between).alias("text"))


def headings(lines: DataFrame, keys: list[str], size: float = 3.0) -> DataFrame:
    """Each page's title, the longest row of lines within one y bucket (the first of equals), and its slogan, the first other row."""
    rows = lines.groupBy(*keys, F.floor(F.col("y") / size + 0.5).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("x", "line_seq", "text"))).alias("p"), F.min("line_seq").alias("seq"))
    rows = rows.select(*keys, "seq", X.trim_ws(F.array_join(F.transform("p", lambda q: q.text), "")).alias("t")).where("t <> ''")
    page = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("r"), F.max_by("t", F.struct(F.length("t"), -F.col("seq"))).alias("title"))  # one page's rows
    return page.select(*keys, "title", F.get(F.filter("r", lambda q: q.t != F.col("title")), F.lit(0)).t.alias("slogan"))


def gaps(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``lines`` with ``gap``: the space above each, from the bottom of the line before it on its side of the table, never below 0."""
    before = F.lag(F.col("y") + F.col("height")).over(W.partitionBy(*keys).orderBy(*order))
    return lines.withColumn("gap", F.greatest(F.lit(0.0), F.col("y") - F.coalesce(before, F.lit(0.0))))


def placed_gaps(lines: DataFrame, tables: DataFrame, keys: list[str], start: float = 0.0) -> DataFrame:
    """Texts and tables of a page in the order in which a document takes them, with the ``gap`` above each: ``keys, kind, seq, place, gap``.

    Lines ``(keys, line_seq, y, size)`` above the first table come first, by y; then all tables ``(keys, table_seq, y, bottom)``; then the other
    lines. A gap is counted from the end of what was placed last, so from the last table's bottom for the first line under it, and never below 0.
    """
    first = tables.groupBy(*keys).agg(F.min_by("y", "table_seq").alias("top"))
    part = F.when(F.col("top").isNull() | (F.col("y") < F.col("top")), 0).otherwise(2)
    n = lines.join(first, keys, "left").select(*keys, F.lit("text").alias("kind"), F.col("line_seq").alias("seq"), part.alias("part"), F.col("y").alias("at"), "y", (F.col("y") + F.col("size")).alias("end"))
    t = tables.select(*keys, F.lit("table").alias("kind"), F.col("table_seq").alias("seq"), F.lit(1).alias("part"), F.col("table_seq").cast("double").alias("at"), "y", F.col("bottom").alias("end"))
    w = W.partitionBy(*keys).orderBy("part", "at", "seq")
    gap = F.greatest(F.lit(0.0), F.col("y") - F.coalesce(F.lag("end").over(w), F.lit(start)))
    return n.union(t).select(*keys, "kind", "seq", (F.row_number().over(w) - 1).alias("place"), gap.alias("gap"))


def absent_texts(paragraphs: DataFrame, lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Paragraphs whose trimmed text none of their page's lines has; equal paragraphs stay side by side."""
    mark = lambda df: df.withColumn("_t", X.trim_ws(F.col(text)))
    return mark(paragraphs).join(mark(lines).select(*keys, "_t"), [*keys, "_t"], "left_anti").drop("_t")


def zipped_pages(pages: DataFrame, others: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages with what another reader found on the page of the same place; pages that it lacks stay with nulls."""
    return pages.join(others, [doc, "page_index"], "left")


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of spans ``(keys, seq, text, font, size, bold)``: their texts joined, with the style of the longest span, the first of equals; blank lines go."""
    style = F.max_by(F.struct("font", "size", "bold"), F.struct(F.length("text"), -F.col("seq")))
    one = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s"), style.alias("style"))
    return one.select(*keys, X.trim_ws(F.array_join(F.transform("s", lambda s: s.text), "")).alias("text"), "style.*").where("text <> ''")


def line_align(x: Column, left: Column, width: Column, merged: Column) -> Column:
    """A cell's alignment by where its first text starts: over 0.3 and under 0.7 centre, over 0.8 right; merged cells are centred."""
    r = (x - left) / width
    return F.when(merged, "center").when((r > 0.3) & (r < 0.7), "center").when(r > 0.8, "right").otherwise("left")


def merged_row(data: Column) -> Column:
    """Whether a row of at least two columns has no second cell."""
    return (F.size(data) >= 2) & F.get(data, F.lit(1)).isNull()


def pushed_down(lines: DataFrame, tables: DataFrame, keys: list[str], table_gap: float = 10.0, line_gap: float = 4.0) -> DataFrame:
    """Lines in order of ``line_seq`` moved below the tables that they meet and below the line before them.

    Each place depends on the last one's, so a page's lines are folded; ``tables`` is the page's few tables in order of ``table_seq``.
    """
    t = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_seq", "y", "height"))).alias("tables"))
    n = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_seq", "y", "height"))).alias("lines"))
    page = n.join(t, keys, "left").withColumn("tables", F.coalesce("tables", F.from_json(F.lit("[]"), "array<struct<table_seq:int,y:double,height:double>>")))

    def place(acc: Column, line: Column) -> Column:
        below = F.aggregate("tables", line.y, lambda y, b: F.when((y < b.y + b.height) & (y + line.height > b.y), b.y + b.height + table_gap).otherwise(y))
        y = F.greatest(below, acc.cursor)
        return F.struct((y + line.height + line_gap).alias("cursor"), F.array_append(acc.out, F.struct(line.line_seq.alias("line_seq"), y.alias("y"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("cursor"), F.from_json(F.lit("[]"), "array<struct<line_seq:int,y:double>>").alias("out"))
    moved = page.select(*keys, F.explode(F.aggregate("lines", start, place, lambda a: a.out)).alias("m"))
    return lines.drop("y").join(moved.select(*keys, "m.line_seq", "m.y"), [*keys, "line_seq"])


def visible_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells ``(row, col, row_span, col_span)`` that no earlier cell's span covers; covered ones go with what they span.

    A page is folded row by row.  What is carried on is the spans that reach the row, so a cell is held against about a row's worth of them, not all cells before it.
    """
    page = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "row_span", "col_span"))).alias("cells"))
    page = page.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    covers = lambda k, c: (c.col >= k.col) & (c.col < k.col + k.col_span)
    empty = lambda kind: F.from_json(F.lit("[]"), f"array<{kind}>")
    span, held = "struct<to:int,col:int,col_span:int>", "struct<row:int,cols:array<int>>"

    def in_row(row: Column) -> Column:
        def place(a: Column, c: Column) -> Column:
            reach = F.struct((row.row + c.row_span).cast("int").alias("to"), c.col.cast("int").alias("col"), c.col_span.cast("int").alias("col_span"))
            spans = F.when((c.row_span > 0) & ((c.row_span > 1) | (c.col_span > 1)), F.array_append(a.open, reach)).otherwise(a.open)
            return F.when(F.exists(a.open, lambda k: covers(k, c)), a).otherwise(F.struct(spans.alias("open"), F.array_append(a.cols, c.col.cast("int")).alias("cols")))

        return place

    def next_row(acc: Column, row: Column) -> Column:
        start = F.struct(F.filter(acc.open, lambda k: k.to > row.row).alias("open"), empty("int").alias("cols"))
        done = F.aggregate(row.cells, start, in_row(row), lambda a: F.struct(a.open.alias("open"), F.array_append(acc.kept, F.struct(row.row.cast("int").alias("row"), F.array_distinct(a.cols).alias("cols"))).alias("kept")))
        return done

    kept = F.aggregate("rows", F.struct(empty(span).alias("open"), empty(held).alias("kept")), next_row, lambda a: a.kept)
    shown = page.select(*keys, F.explode(kept).alias("r")).select(*keys, "r.row", F.explode("r.cols").alias("col"))
    return shown.join(cells, [*keys, "row", "col"])


def interleaved(lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and tables of a page in reading order: by y, tables before lines of the same y. ``kind, seq, y, place``."""
    both = tables.select(*keys, F.lit(0).alias("kind"), F.col("table_seq").alias("seq"), "y").union(lines.select(*keys, F.lit(1).alias("kind"), F.col("line_seq").alias("seq"), "y"))
    return both.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("y", "kind", "seq")) - 1)


def nearest_edge(edges: Column, value: Column) -> Column:
    """The index of the edge nearest to a value, the first of equals."""
    return F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - value).alias("d"), i.alias("i")))).i


def letter_spacing(width: Column, natural: Column, text: Column) -> Column:
    """Percent by which letters are spread to fill a width, from -50 to 50 (halves away from 0); 0 where a width is unknown or tiny."""
    usable = (natural > 0.5) & (width > 0.5) & (F.length(text) > 1)
    return F.when(usable, F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.round((width / natural - 1) * 100)))).otherwise(0.0).cast("int")


def box_top(baseline: Column, y: Column, box_height: Column, scale: Column) -> Column:
    """The export's top: so that the text's baseline lies at 0.85 of the box; without a baseline y itself."""
    top = baseline - 0.85 * (box_height / F.greatest(scale, F.lit(1.0)))
    return F.round(F.greatest(F.coalesce(top, y), F.lit(0.0)) * scale).cast("long")


def without_table_rules(boxes: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes but for thin full-width rules less than 25 below a table."""
    b, t = boxes.alias("b"), tables.alias("t")
    under = F.col("b.y") - (F.col("t.y") + F.col("t.height"))
    on = (F.col("b.width") >= F.col("t.width") * 0.95) & (F.col("b.x") <= F.col("t.x") + 2) & (under > 0) & (under < 25) & (F.col("b.height") <= 3)
    for k in keys:
        on = on & (F.col(f"b.{k}") == F.col(f"t.{k}"))
    return b.join(t, on, "left_anti")


def kept_fills(boxes: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Filled shapes of at least 2 points that neither cover the page nor are white."""
    page = (F.col("width") > page_w * 0.95) & (F.col("height") > page_h * 0.95)
    return boxes.where(F.col("fill").isNotNull() & (F.col("width") >= 2) & (F.col("height") >= 2) & ~page & ~F.upper("fill").isin("#FFFFFF", "#FFFFFE"))


def result_name(name: Column, extension: str, new: str) -> Column:
    """A file's name with its extension replaced, whatever its case."""
    return F.regexp_replace(name, rf"(?i)\.{extension}$", f".{new}")


def media_of(blocks: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """Image placeholder paragraphs with their medium, the first of that id in order of ``media_seq``."""
    first = media.groupBy(*keys, "id").agg(F.min_by(F.struct("natural_w", "natural_h"), "media_seq").alias("m"))
    ids = blocks.withColumn("id", F.regexp_extract("text", r"^\[이미지: ([^\]]+)\]$", 1)).where("id <> ''")
    return ids.join(first, [*keys, "id"], "left").select(*ids.columns, "m.*")


#: What a page without text before its table is called, where a table stands that moves no margin, and that margin; hundredths of a point, and the least side of a cell.
UNTITLED, TABLE_TOP, TOP_MARGIN, PER_POINT, LEAST_CELL = "PDF 문서", 124.55, 9600, 100, 300


def structured_pages(lines: DataFrame, tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each page as one nested row: ``keys, title, slogan, margin_top, width, rows``; ``rows`` are those of its first table, null without one.

    ``tables`` has ``(keys, table_seq, y, width, columns, row_heights)``, ``cells`` ``(keys, table_seq, cell_seq, row, col, row_span, col_span, text)``; of several cells of
    one place the last counts.  Every place of the grid that no span covers has a cell, an empty one where none is given; a row that is
    covered throughout has none.  Title and slogan come from the lines above the table.
    """
    rounded = lambda c: F.floor(c * PER_POINT + 0.5).cast("int")
    side = lambda sizes, at, n: F.greatest(F.lit(LEAST_CELL), rounded(F.aggregate(F.slice(sizes, at + 1, n), F.lit(0.0), lambda a, b: a + b)))
    first = tables.groupBy(*keys).agg(F.min_by(F.struct("table_seq", "y", "width", "columns", "row_heights"), "table_seq").alias("t"))
    heads = headings(lines.join(first, keys, "left").where(F.col("t").isNull() | (F.col("y") < F.col("t.y"))).select(lines.columns), keys)
    gridded = first.where((F.size("t.columns") > 0) & (F.size("t.row_heights") > 0))
    each_row = gridded.select(*keys, "t", F.explode(F.sequence(F.lit(0), F.size("t.row_heights") - 1)).alias("row"))
    grid = each_row.select(*keys, "t", "row", F.explode(F.sequence(F.lit(0), F.size("t.columns") - 1)).alias("col"))
    given = cells.groupBy(*keys, "table_seq", "row", "col").agg(F.max_by(F.struct("row_span", "col_span", "text"), "cell_seq").alias("c"))
    given = given.join(first.select(*keys, F.col("t.table_seq").alias("table_seq")), [*keys, "table_seq"]).drop("table_seq")
    span = lambda name: F.greatest(F.lit(1), F.coalesce(F.col(f"c.{name}"), F.lit(1))).alias(name)
    full = grid.join(given, [*keys, "row", "col"], "left").select(*keys, "row", "col", "t", span("row_span"), span("col_span"), F.coalesce("c.text", F.lit("")).alias("text"))
    shown = visible_cells(full, keys)
    one = F.struct("col", "text", "col_span", "row_span", side(F.col("t.columns"), F.col("col"), F.col("col_span")).alias("width"), side(F.col("t.row_heights"), F.col("row"), F.col("row_span")).alias("height"))
    by_row = shown.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    rows = each_row.join(by_row, [*keys, "row"], "left").select(*keys, F.struct("row", side(F.col("t.row_heights"), F.col("row"), F.lit(1)).alias("height"), F.coalesce("cells", F.array().cast(dict(by_row.dtypes)["cells"])).alias("cells")).alias("r"))
    built = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    pages = lines.select(*keys).union(tables.select(*keys)).distinct()
    out = pages.join(heads, keys, "left").join(first, keys, "left").join(built, keys, "left")
    margin = F.greatest(F.lit(0), TOP_MARGIN + F.coalesce(rounded(F.col("t.y") - TABLE_TOP), F.lit(0)))
    return out.select(*keys, F.coalesce("title", F.lit(UNTITLED)).alias("title"), "slogan", margin.alias("margin_top"), F.when(F.col("rows").isNotNull(), rounded(F.col("t.width"))).alias("width"), "rows")
