"""Boxes out of drawings, text on them, and what else a page's geometry tells.

Coordinates are in points, y grows downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import trim_ws
from leafmill.operators.layout import inside

#: Which boxes are kept, how straight and how thick a rule is.
LONG, THIN, SOME = 5.0, 0.3, 1.0
STRAIGHT, SEGMENT, STROKE, HAIR = 0.75, 0.5, 0.5, 0.4


def kept_size(width: Column, height: Column) -> Column:
    """Whether a box is large enough: rules of some length, or a point each way."""
    rule = ((width >= LONG) & (height >= THIN)) | ((height >= LONG) & (width >= THIN))
    return (width > 0) & (height > 0) & (rule | ((width >= SOME) & (height >= SOME)))


def drawn_size(width: Column, height: Column) -> Column:
    """The same for whole drawings, where more than a point each way is asked for."""
    return ((width >= LONG) & (height >= THIN)) | ((height >= LONG) & (width >= THIN)) | ((width > SOME) & (height > SOME))


def segment_box(x0: Column, y0: Column, x1: Column, y1: Column, stroke_width: Column) -> Column:
    """``struct<x, y, width, height>`` of a level or upright segment, as thick as its stroke and centred on it; null for others."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    thick = F.greatest(F.coalesce(F.nullif(stroke_width, F.lit(0.0)), F.lit(STROKE)), F.lit(HAIR))
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    left, top = F.least(x0, x1), F.least(y0, y1)
    level = box(left, top - thick / 2, dx, F.greatest(dy, thick))
    upright = box(left - thick / 2, top, F.greatest(dx, thick), dy)
    return F.when((dy <= STRAIGHT) & (dx >= SEGMENT), level).when((dx <= STRAIGHT) & (dy >= SEGMENT), upright)


def drawing_boxes(items: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes ``keys, drawing_seq, item_seq, x, y, width, height, stroke, fill, stroke_width`` of drawings, and rows with ``raster`` for those that are none.

    ``drawings`` has ``keys, drawing_seq, x0, y0, x1, y1, stroke, fill, stroke_width`` (its bounds), ``items`` has ``keys, drawing_seq, item_seq, op, x0, y0,
    x1, y1``: ``re`` rectangles, ``l`` segments, ``c``, ``qu``, ``v`` and ``y`` curves. A drawing without boxes is a raster if it has curves or slanted segments,
    else its bounds are a box.
    """
    on = [*keys, "drawing_seq"]
    stroke = F.when(F.col("fill").isNull() & F.col("stroke").isNull(), "#000000").otherwise(F.col("stroke")).alias("stroke")
    d = drawings.select(*on, stroke, "fill", "stroke_width", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    i = items.join(d, on)
    size = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    rule = segment_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("stroke_width"))
    i = i.withColumn("b", F.when(F.col("op") == "re", size).when(F.col("op") == "l", rule)).withColumn("line", F.col("op") == "l")
    good = i.where(kept_size(F.col("b.width"), F.col("b.height")))
    own = F.coalesce(F.nullif("stroke_width", F.lit(0.0)), F.when(F.col("line"), F.greatest(F.coalesce(F.nullif("stroke_width", F.lit(0.0)), F.lit(STROKE)), F.lit(HAIR))), F.col("stroke_width"))
    boxes = good.select(*on, "item_seq", "b.*", F.coalesce("stroke", F.when(F.col("line"), "#000000")).alias("stroke"), F.when(~F.col("line"), F.col("fill")).alias("fill"), own.alias("stroke_width"), F.lit(False).alias("raster"))
    odd = i.where(F.col("op").isin("c", "qu", "v", "y") | (F.col("line") & F.col("b").isNull())).select(*on).distinct().withColumn("odd", F.lit(True))
    rest = d.join(boxes.select(*on).distinct(), on, "left_anti").join(odd, on, "left")
    width, height = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    raster = F.coalesce("odd", F.lit(False))
    rest = rest.where(raster | kept_size(width, height))
    bounds = rest.select(*on, F.lit(None).cast("int").alias("item_seq"), F.col("_x0").alias("x"), F.col("_y0").alias("y"), width.alias("width"), height.alias("height"), "stroke", "fill", "stroke_width", raster.alias("raster"))
    return boxes.unionByName(bounds)


def vector_page(drawings: DataFrame, lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A page's boxes from the bounds of its drawings, and the lines whose centre lies on a filled one."""
    b = drawings.select(*keys, "drawing_seq", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "stroke", "fill")
    boxes = b.where(drawn_size(F.col("width"), F.col("height"))).withColumn("stroke", F.when(F.col("fill").isNull() & F.col("stroke").isNull(), "#000000").otherwise(F.col("stroke")))
    on_fill = inside(lines.where(trim_ws(F.col("text")) != ""), boxes.where("fill is not null"), keys, 0.0, "left_semi")
    return boxes, on_fill


def with_origin(lines: DataFrame, origins: DataFrame, keys: list[str]) -> DataFrame:
    """``lines(keys, y, text)`` with the columns of their origin: equal trimmed text and equal y to a tenth (halves to even); the last of equals by ``seq``."""
    key = lambda df: df.withColumn("_y", F.bround("y", 1)).withColumn("_t", trim_ws(F.col("text")))
    rest = [c for c in origins.columns if c not in (*keys, "y", "text", "seq")]
    last = key(origins).groupBy(*keys, "_y", "_t").agg(F.max_by(F.struct(*rest), "seq").alias("o"))
    return key(lines).join(last, [*keys, "_y", "_t"], "left").select(*lines.columns, "o.*")


def line_metrics(y0: Column, y1: Column, size: Column, origin_y: Column, ascender: Column, descender: Column) -> tuple[Column, Column, Column]:
    """Baseline, top and height of a line by its font: from its origin where one is known, else from its box; 0 counts as unknown, but for where the origin is."""
    known = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    up, down = known(ascender, 0.8), known(descender, -0.2)
    baseline = F.coalesce(F.nullif(origin_y, F.lit(0.0)), y0 + size * 0.8)
    return baseline, F.when(origin_y.isNotNull(), baseline - size * up).otherwise(y0), F.greatest(size * (up - down), y1 - y0, size)


def flagged_images(images: DataFrame, tables: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """``images(keys, image_seq, x0, y0, x1, y1)`` of a point at least each way with ``behind``: whether a table or a text's first stretch lies under it."""
    shown = images.where((F.col("x1") - F.col("x0") >= 1) & (F.col("y1") - F.col("y0") >= 1))
    t = texts.select(*keys, (F.col("x") - 2).alias("x0"), (F.col("y") - 2).alias("y0"), (F.col("x") + 200).alias("x1"), (F.col("y") + 2).alias("y1"))
    rects = tables.select(*keys, "x0", "y0", "x1", "y1").union(t).alias("r")
    i = shown.alias("i")
    on = (F.col("i.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("i.x1")) & (F.col("i.y0") < F.col("r.y1")) & (F.col("r.y0") < F.col("i.y1"))
    for k in keys:
        on = on & (F.col(f"i.{k}") == F.col(f"r.{k}"))
    hit = i.join(rects, on, "left_semi").select(*keys, "image_seq").withColumn("behind", F.lit(True))
    return shown.join(hit, [*keys, "image_seq"], "left").withColumn("behind", F.coalesce("behind", F.lit(False)))


def cell_edges(cells: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """``keys, edges, steps``: the distinct ends of a table's cells to a tenth, in order, and what lies between them."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.bround(low, 1), F.bround(high, 1))))))
    e = cells.groupBy(*keys).agg(ends.alias("edges"))  # one table's edges
    steps = F.transform(F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))), lambda v, i: v - F.get("edges", i))
    return e.select(*keys, "edges", steps.alias("steps"))


def leading_bottom(lines: DataFrame, tables: DataFrame, keys: list[str], start: float = 72.0, gap: float = 10.0) -> DataFrame:
    """``tables(keys, table_seq, line_seq)`` with the least ``y`` that lies under all lines before their place."""
    n, t = lines.alias("n"), tables.alias("t")
    on = F.col("n.line_seq") < F.col("t.line_seq")
    for k in keys:
        on = on & (F.col(f"n.{k}") == F.col(f"t.{k}"))
    low = t.join(n, on).groupBy(*(F.col(f"t.{k}") for k in [*keys, "table_seq"])).agg(F.max(F.col("n.y") + F.col("n.height")).alias("low"))
    return tables.join(low, [*keys, "table_seq"], "left").withColumn("y", F.greatest(F.lit(start), F.coalesce(F.when(F.col("low") > 0, F.col("low") + gap), F.lit(start)))).drop("low")


def stamped(pages: DataFrame, numbers: Column) -> DataFrame:
    """Pages whose number from 1 is asked for; all if none is."""
    return pages.where((F.size(numbers) == 0) | F.array_contains(numbers, F.col("page_index") + 1))


def image_pages(images: DataFrame, doc: str) -> DataFrame:
    """JPEG and PNG images ``(doc, file_seq, kind, width, height)`` as pages of their size, in order of the files; others make none."""
    fit = images.where(F.col("kind").isin("image/jpeg", "image/png"))
    return fit.withColumn("page_index", F.row_number().over(W.partitionBy(doc).orderBy("file_seq")) - 1)


def contents_preview(lines: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """The first lines of each page in one."""
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_seq", "text"))), 1, n), lambda s: s.text)
    return lines.groupBy(*keys).agg(F.array_join(texts, " | ").alias("preview"))


def newest(files: DataFrame, folder: str, path: str, at: str) -> DataFrame:
    """Each folder's newest file, the first by name of equals."""
    best = F.min(F.struct((-F.unix_micros(at)).alias("age"), path)).alias("b")
    return files.groupBy(folder).agg(best).select(folder, F.col(f"b.{path}").alias(path))


def page_point(x: Column, y: Column, shown_w: Column, shown_h: Column, page_w: Column, page_h: Column, centre: tuple[float, float] = (40.0, 20.0)) -> tuple[Column, Column]:
    """A place on the screen as whole points of the page, moved to the mark's centre; halves round up."""
    return F.floor(x / shown_w * page_w + centre[0] + 0.5), F.floor(y / shown_h * page_h + centre[1] + 0.5)
