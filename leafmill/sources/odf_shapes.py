"""Frames, lines and polygons of ODF texts as boxes, lines of text and images of their pages, with graphic styles and page size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.sources.markup import _tags, odf_properties, odf_styles

#: An A4 page in inches, at 96 pixels an inch; the part of a frame's height that its text takes where no style says so, and the least size.
PAGE, TEXT_PART, LEAST_TEXT = (8.2681 * 96, 11.6929 * 96), 0.72, 8.0


def odf_page_size(xml: Column) -> tuple[Column, Column]:
    """Width and height of the first page layout in pixels; A4 where there is none."""
    found = X.attributes(F.regexp_extract(xml, r"(?s)<style:page-layout\b[^>]*>.*?<style:page-layout-properties\b([^>]*)/>", 1))
    return X.odf_px(found["fo:page-width"], PAGE[0]), X.odf_px(found["fo:page-height"], PAGE[1])


def graphic_styles(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """``keys, style, stroke, fill``: black strokes unless told otherwise, fills only where they are solid."""
    p = F.col("p")
    stroke = F.when(F.coalesce(p["draw:stroke"], F.lit("")) != "none", F.coalesce(F.nullif(p["svg:stroke-color"], F.lit("")), F.lit("#000000")))
    fill = F.when(p["draw:fill"] == "solid", F.coalesce(F.nullif(p["draw:fill-color"], F.lit("")), F.lit("#FFFFFF")))
    return odf_properties(df, keys, "graphic", xml).select(*keys, "style", stroke.alias("stroke"), fill.alias("fill"))


def _drawn(df: DataFrame, keys: list[str], xml: str, names: str) -> DataFrame:
    """Elements outside tables with attributes ``a``, inner text ``body`` and ``page`` (from 1), and their graphic style's stroke and fill."""
    bare = df.withColumn(xml, F.regexp_replace(xml, r"(?s)<table:table(?!-)\b.*?</table:table>", ""))
    t = _tags(bare, keys, xml, rf"(?s)<draw:(?:{names})\b([^>]*)>(.*?)</draw:(?:{names})>", "seq", 2).withColumn("a", X.attributes(F.col("g1")))
    page = F.greatest(F.lit(1), F.coalesce(F.col("a")["text:anchor-page-number"].try_cast("int"), F.lit(1)))
    t = t.select(*keys, "seq", "a", F.col("g2").alias("body"), page.alias("page"), F.col("a")["draw:style-name"].alias("style"))
    return t.join(graphic_styles(df, keys, xml), [*keys, "style"], "left")


def _px(name: str, least: float | None = None) -> Column:
    v = X.odf_px(F.col("a")[name], least or 0.0)
    return v if least is None else F.greatest(F.lit(least), v)


def _placed(t: DataFrame) -> DataFrame:
    return t.withColumns({"x": _px("svg:x"), "y": _px("svg:y"), "width": _px("svg:width", 1.0), "height": _px("svg:height", 1.0)})


def odf_boxes(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """``keys, page, kind, seq, x, y, width, height, stroke, fill`` of text frames, lines, polygons and rectangles.

    A frame or shape without stroke and fill isn't there to be seen and has no row; a line is always drawn and at least one pixel thick.
    """
    shown = F.col("stroke").isNotNull() | F.col("fill").isNotNull()
    frames = _placed(_drawn(df, keys, xml, "frame")).where(shown & ~F.col("body").rlike(r"<draw:image\b") & F.col("body").rlike(r"(?i)<draw:text-box\b")).withColumn("kind", F.lit("frame"))
    shapes = _placed(_drawn(df, keys, xml, "polygon|rect")).where(shown).withColumn("kind", F.lit("shape"))
    ends = {n: _px(f"svg:{n}") for n in ("x1", "y1", "x2", "y2")}
    side = lambda p, q: F.greatest(F.lit(1.0), F.abs(ends[q] - ends[p]))
    lines = _drawn(df, keys, xml, "line").withColumns({"kind": F.lit("line"), "x": F.least(ends["x1"], ends["x2"]), "y": F.least(ends["y1"], ends["y2"]), "width": side("x1", "x2"), "height": side("y1", "y2"), "stroke": F.coalesce("stroke", F.lit("#000000")), "fill": F.lit(None).cast("string")})
    columns = [*keys, "page", "kind", "seq", "x", "y", "width", "height", "stroke", "fill"]
    return frames.select(columns).unionByName(shapes.select(columns)).unionByName(lines.select(columns))


def odf_frame_lines(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Texts of text frames, in the style of their first span, or else in a size that follows the frame's height."""
    t = _placed(_drawn(df, keys, xml, "frame")).where(~F.col("body").rlike(r"<draw:image\b") & F.col("body").rlike(r"(?i)<draw:text-box\b"))
    t = t.withColumn("text", X.decode_odf(F.col("body"))).where("text <> ''").withColumn("style", F.regexp_extract("body", r'<text:span\b[^>]*text:style-name="([^"]+)"', 1))
    known = odf_styles(df, keys, xml).select(*keys, "style", "font_family", "font_size", "bold", "color")
    size = F.coalesce("font_size", F.greatest(F.lit(LEAST_TEXT), F.col("height") * TEXT_PART))
    return t.join(known, [*keys, "style"], "left").select(*keys, "page", "seq", "text", "x", "y", "width", "height", F.coalesce("font_family", F.lit(X.DEFAULT_FONT)).alias("font_family"), size.alias("font_size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("color", F.lit("#000000")).alias("color"))


def odf_images(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Images of frames, numbered on their page; ``natural_w`` and ``natural_h`` are the frame's rounded sizes where the file itself isn't asked."""
    href = X.attributes(F.regexp_extract("body", r"<draw:image\b([^>]*)>", 1))["xlink:href"]
    t = _placed(_drawn(df, keys, xml, "frame")).withColumn("href", F.nullif(href, F.lit(""))).where("href is not null")
    number = F.row_number().over(W.partitionBy(*keys, "page").orderBy("seq"))
    ext = F.coalesce(F.nullif(F.regexp_extract("href", r"[^/](\.[^./]*)$", 1), F.lit("")), F.lit(".png"))
    near = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    return t.select(*keys, "page", "seq", F.concat(F.lit("odt-image-"), number.cast("string"), ext).alias("id"), "href", "x", "y", "width", "height", near("width").alias("natural_w"), near("height").alias("natural_h"))
