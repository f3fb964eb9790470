"""Pages, glyphs and styles out of markup texts held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import layout as L


def _tags(df: DataFrame, keys: list[str], column: str, pattern: str, seq: str, groups: int = 1) -> DataFrame:
    """One row for each match, with its groups ``g1``, ``g2``..."""
    found = [F.regexp_extract_all(column, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    zipped = F.arrays_zip(*(f.alias(f"g{i + 1}") for i, f in enumerate(found)))
    out = df.select(*keys, F.posexplode(zipped).alias(seq, "m"))
    return out.select(*keys, seq, *(F.col(f"m.g{i + 1}").alias(f"g{i + 1}") for i in range(groups)))


def _number(attrs: Column, name: str, default: float) -> Column:
    """A numeric attribute; the default where it is missing, no number or 0."""
    v = attrs[name].try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v == 0), F.lit(float(default))).otherwise(v)


#: A4 at 96 dpi, and the kinds of images that a picture may embed.
A4_PX = (793.7066666666667, 1122.5066666666667)
IMAGE_KINDS = "png|jpe?g|gif|webp"


def svg_size(svg: Column) -> tuple[Column, Column]:
    """Width and height: both attributes, else the view box, else A4."""
    tag = X.attributes(F.regexp_extract(svg, r"(?i)<svg\b([^>]*)>", 1))
    pixels = lambda name: F.regexp_replace(tag[name], "(?i)px$", "").try_cast("double")
    box = F.split(F.trim(tag["viewBox"]), r"\s+")
    both = pixels("width").isNotNull() & pixels("height").isNotNull()
    side = lambda name, i: F.coalesce(F.when(both, pixels(name)), F.get(box, F.lit(2 + i)).try_cast("double"), F.lit(A4_PX[i]))
    return side("width", 0), side("height", 1)


def svg_glyphs(df: DataFrame, keys: list[str], svg: str = "svg") -> DataFrame:
    t = _tags(df, keys, svg, r"(?is)<text\b([^>]*)>(.*?)</text>", "seq", 2).withColumn("a", X.attributes(F.col("g1")))
    text = lambda n, d: F.coalesce(F.nullif(F.col("a")[n], F.lit("")), F.lit(d)).alias(n.replace("-", "_"))
    return t.select(*keys, "seq", F.coalesce(F.col("a")["x"].try_cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col("a")["y"].try_cast("double"), F.lit(0.0)).alias("y"), _number(F.col("a"), "font-size", 12).alias("font_size"), text("fill", "#000000"), text("font-family", "Helvetica"), text("font-weight", ""), F.col("g2").alias("content"))


def svg_rects(df: DataFrame, keys: list[str], svg: str = "svg") -> DataFrame:
    """Rectangles with an area."""
    num = lambda a, n: F.coalesce(a[n].try_cast("double"), F.lit(0.0)).alias(n.replace("-", "_"))
    rect = lambda a: F.struct(*(num(a, n) for n in ("x", "y", "width", "height", "stroke-width")), a["fill"].alias("fill"), a["stroke"].alias("stroke"))
    found = F.regexp_extract_all(svg, F.lit(r"(?i)<rect\b([^>]*)/?>"), F.lit(1))
    # Numbers are taken where the tag is read: a filter on columns of maps would make the maps once more for each side.
    t = df.select(*keys, F.posexplode(F.transform(found, lambda g: X.bound(X.attributes(g), rect))).alias("seq", "r"))
    return t.where("r.width > 0 and r.height > 0").select(*keys, "seq", "r.*")


def svg_images(df: DataFrame, keys: list[str], svg: str = "svg") -> DataFrame:
    """Embedded images, numbered from 1, with their kind and bytes."""
    t = _tags(df, keys, svg, rf"""(?i)\bhref=["']data:image/({IMAGE_KINDS});base64,([^"']+)["']""", "seq", 2)
    kind = F.regexp_replace(F.lower("g1"), "^jpeg$", "jpg")
    return t.select(*keys, (F.col("seq") + 1).alias("number"), kind.alias("kind"), F.expr("try_to_binary(regexp_replace(g2, '\\\\s+', ''), 'base64')").alias("content"))


def xml_pages(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Pages of a layout XML with their bodies."""
    t = _tags(df, keys, xml, r"(?s)<page\b([^>]*)>(.*?)</page>", "page_index", 2).withColumn("a", X.attributes(F.col("g1")))
    return t.select(*keys, "page_index", _number(F.col("a"), "width", 892).alias("width"), _number(F.col("a"), "height", 1262).alias("height"), F.col("g2").alias("body"))


def xml_lines(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Text lines of a layout XML with their fonts; a font's last specification counts, and lines of an unknown font get a default one."""
    spec = _tags(df, keys, xml, r"<fontspec\b([^>]*)/>", "i").withColumn("a", X.attributes(F.col("g1"))).where("coalesce(a['id'], '') <> ''")
    fonts = spec.groupBy(*keys, F.col("a")["id"].alias("font")).agg(F.max_by("a", "i").alias("f"))
    lines = _tags(xml_pages(df, keys, xml), [*keys, "page_index"], "body", r"(?s)<text\b([^>]*)>(.*?)</text>", "line_seq", 2)
    lines = lines.withColumn("a", X.attributes(F.col("g1"))).withColumn("text", X.normal_word(F.col("g2"))).where("text <> ''").withColumn("font", F.coalesce(F.col("a")["font"], F.lit("")))
    j = lines.join(fonts, [*keys, "font"], "left")
    a, f = F.col("a"), F.col("f")
    own = F.greatest(F.lit(8.0), _number(a, "height", 16))
    size = F.when(f.isNull(), own).otherwise(_number(f, "size", 12))
    word = lambda n, d: F.coalesce(F.nullif(f[n], F.lit("")), F.lit(d))
    return j.select(
        *keys, "page_index", "line_seq", "text", F.coalesce(a["left"].try_cast("double"), F.lit(0.0)).alias("x"), F.coalesce(a["top"].try_cast("double"), F.lit(0.0)).alias("y"),
        F.greatest(F.lit(1.0), _number(a, "width", 1)).alias("width"), F.greatest(F.lit(1.0), F.when(a["height"].isNull(), size).otherwise(_number(a, "height", 12))).alias("height"),
        word("family", X.DEFAULT_FONT).alias("font_family"), size.alias("font_size"), F.col("g2").rlike(r"(?i)<b\b").alias("bold"), word("color", "#000000").alias("color"),
    )


def word_boxes(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Words with finite boxes of some size."""
    t = _tags(df, keys, xml, r"(?s)<word\b([^>]*)>(.*?)</word>", "word_seq", 2).withColumn("a", X.attributes(F.col("g1")))
    edge = {n: F.col("a")[n].try_cast("double") for n in ("xMin", "yMin", "xMax", "yMax")}
    return t.select(*keys, "word_seq", X.normal_word(F.col("g2")).alias("text"), edge["xMin"].alias("x"), edge["yMin"].alias("y"), (edge["xMax"] - edge["xMin"]).alias("width"), (edge["yMax"] - edge["yMin"]).alias("height")).where("text <> '' and width > 0 and height > 0 and not isnan(width) and not isnan(height)")


def odf_styles(df: DataFrame, keys: list[str], xml: str = "xml", family: str = "text") -> DataFrame:
    """Styles of a family: name, parent and the properties of its inner tags."""
    t = _tags(df, keys, xml, r"(?s)<style:style\b([^>]*)>(.*?)</style:style>", "i", 2).withColumn("a", X.attributes(F.col("g1"))).withColumn("p", X.attributes(F.col("g2")))
    t = t.where((F.col("a")["style:family"] == family) & F.col("a")["style:name"].isNotNull())
    last = t.groupBy(*keys, F.col("a")["style:name"].alias("style")).agg(F.max_by(F.struct("a", "p"), "i").alias("s"))
    return last.select(*keys, "style", F.col("s.a")["style:parent-style-name"].alias("parent"), X.normal_font(F.coalesce(F.col("s.p")["style:font-name"], F.col("s.p")["fo:font-family"])).alias("font_family"), X.odf_pt(F.col("s.p")["fo:font-size"]).alias("font_size"), (F.coalesce(F.col("s.p")["fo:font-weight"], F.lit("")) == "bold").alias("bold"), F.coalesce(F.col("s.p")["fo:color"], F.lit("#000000")).alias("color"))


def odf_paragraphs(df: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Paragraphs with their style and text; blank ones are dropped."""
    t = _tags(df, keys, xml, r"(?s)<text:(?:p|h)\b([^>]*)>(.*?)</text:(?:p|h)>", "seq", 2)
    return t.select(*keys, "seq", X.attributes(F.col("g1"))["text:style-name"].alias("style"), X.decode_odf(F.col("g2")).alias("text")).where("text <> ''")


def styled(rows: DataFrame, styles: DataFrame, keys: list[str], size: float = 12.0) -> DataFrame:
    """Rows with their style's properties, or the defaults where the style is unknown."""
    j = rows.join(styles.drop("parent"), [*keys, "style"], "left")
    return j.withColumns({"font_family": F.coalesce("font_family", F.lit(X.DEFAULT_FONT)), "font_size": F.coalesce("font_size", F.lit(size)), "bold": F.coalesce("bold", F.lit(False)), "color": F.coalesce("color", F.lit("#000000"))})


def odf_paragraph_lines(df: DataFrame, keys: list[str], styles: DataFrame, xml: str = "xml", start: float = 72.0) -> DataFrame:
    """Paragraphs outside tables with their style and a running ``y``: each stands under the last by 1.4 of its own font size, 12 at least."""
    bare = df.withColumn(xml, F.regexp_replace(xml, r"(?s)<table:table(?!-)\b.*?</table:table>", ""))
    p = styled(odf_paragraphs(bare, keys, xml), styles, keys)
    p = p.withColumn("height", F.greatest(F.lit(12.0), F.col("font_size") * 1.4))
    before = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return p.withColumn("y", F.lit(start) + F.coalesce(F.sum("height").over(before), F.lit(0.0)))


def odf_properties(df: DataFrame, keys: list[str], family: str, xml: str = "xml") -> DataFrame:
    """``keys, style, p``: the properties of a family's styles as maps, the last of equal names."""
    t = _tags(df, keys, xml, r"(?s)<style:style\b([^>]*)>(.*?)</style:style>", "i", 2).withColumn("a", X.attributes(F.col("g1")))
    t = t.where((F.col("a")["style:family"] == family) & F.col("a")["style:name"].isNotNull())
    return t.groupBy(*keys, F.col("a")["style:name"].alias("style")).agg(F.max_by(X.attributes(F.col("g2")), "i").alias("p"))


#: Sizes of table parts without a style, in pixels, and where the first table stands.
COLUMN_PX, ROW_PX, LEAST_ROW_PX, FIRST_TABLE, TABLE_GAP, MARGINS = 96.0, 28.0, 18.0, 72.0, 10.0, 144.0


def odf_tables(df: DataFrame, keys: list[str], page_width: float, xml: str = "xml") -> DataFrame:
    """Cells ``keys, table_seq, row, col, row_span, col_span, x, y, width, height, text, stroke, fill`` of the tables of ODF texts, laid out under each other.

    Covered cells have no row but take a column, besides those that the spanning cell takes; a table is centred on the page; a repeated column counts as
    often as it says.  A row is as high as its style says, or at least; a cell is ruled in the colour of the first border it names, else in black, and a
    transparent background is none.
    """
    first = lambda *names: F.coalesce(*(F.nullif(F.col("p")[n], F.lit("")) for n in names))
    sizes = lambda family, *names: odf_properties(df, keys, family, xml).select(*keys, "style", X.odf_px(first(*names)).alias("px"))
    body = _tags(df, keys, xml, r"(?s)<table:table(?!-)\b([^>]*)>(.*?)</table:table>", "table_seq", 2).select(*keys, "table_seq", F.col("g2").alias("body"))
    on = [*keys, "table_seq"]
    count = lambda a, name: F.greatest(F.lit(1), F.coalesce(a[name].try_cast("int"), F.lit(1)))
    named = lambda t, styles, name: t.withColumn("style", F.col("a")["table:style-name"]).join(styles, [*keys, "style"], "left").withColumn(name, F.nullif("px", F.lit(0.0))).drop("px", "style")
    c = _tags(body, on, "body", r"<table:table-column\b([^>]*?)/>", "i").withColumn("a", X.attributes(F.col("g1")))
    c = named(c, sizes("table-column", "style:column-width"), "w").select(*on, "i", F.array_repeat(F.coalesce("w", F.lit(COLUMN_PX)), count(F.col("a"), "table:number-columns-repeated")).alias("w"))
    widths = c.groupBy(*on).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s.w)).alias("widths"))
    r = _tags(body, on, "body", r"(?s)<table:table-row\b([^>]*)>(.*?)</table:table-row>", "row", 2).withColumn("a", X.attributes(F.col("g1")))
    rows = named(r, sizes("table-row", "style:row-height", "style:min-row-height"), "h").select(*on, "row", "g2", F.greatest(F.lit(LEAST_ROW_PX), F.coalesce("h", F.lit(ROW_PX))).alias("height"))
    t = body.select(*on).join(widths, on, "left").withColumn("widths", F.coalesce("widths", F.array(F.lit(max(1.0, page_width - MARGINS)))))
    t = t.join(rows.groupBy(*on).agg(F.sum("height").alias("tall")), on, "left").withColumn("tall", F.coalesce("tall", F.lit(0.0)))
    above = W.partitionBy(*keys).orderBy("table_seq").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("top", F.lit(FIRST_TABLE) + F.coalesce(F.sum(F.col("tall") + TABLE_GAP).over(above), F.lit(0.0)))
    t = t.withColumn("left", F.greatest(F.lit(0.0), (F.lit(page_width) - _total(F.col("widths"))) / 2))
    rows = rows.withColumn("down", F.coalesce(F.sum("height").over(W.partitionBy(*on).orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    cells = _tags(rows, [*on, "row", "height", "down"], "g2", r"(?s)<table:(table-cell|covered-table-cell)\b((?:[^>/]|/(?!>))*)(?:/>|>(.*?)</table:table-cell>)", "i", 3).withColumn("a", X.attributes(F.col("g2")))
    covered = F.col("g1") == "covered-table-cell"
    cells = cells.withColumn("col_span", F.when(covered, 1).otherwise(count(F.col("a"), "table:number-columns-spanned")))
    cells = cells.withColumn("col", F.coalesce(F.sum("col_span").over(W.partitionBy(*on, "row").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")).where(~covered)
    border = first(*("fo:border" + side for side in ("", "-left", "-right", "-top", "-bottom")))
    colour = F.when(~border.rlike("(?i)none"), F.nullif(F.regexp_extract(border, "(?i)#[0-9a-f]{6}", 0), F.lit("")))
    fill = F.nullif(first("fo:background-color"), F.lit("transparent"))
    looks = odf_properties(df, keys, "table-cell", xml).select(*keys, "style", colour.alias("stroke"), fill.alias("fill"))
    cells = cells.withColumn("style", F.col("a")["table:style-name"]).join(looks, [*keys, "style"], "left").join(t, on)
    paragraphs = F.transform(F.regexp_extract_all(F.coalesce("g3", F.lit("")), F.lit(r"(?s)<text:p\b[^>]*>(.*?)</text:p>"), F.lit(1)), X.decode_odf)
    text = X.trim_ws(F.array_join(F.filter(paragraphs, lambda s: s != ""), "\n"))
    wide = F.nullif(_total(F.slice("widths", F.col("col") + 1, F.col("col_span"))), F.lit(0.0))
    return cells.select(
        *on, "row", "col", count(F.col("a"), "table:number-rows-spanned").alias("row_span"), "col_span", (F.col("left") + _total(F.slice("widths", F.lit(1), F.col("col")))).alias("x"), (F.col("top") + F.col("down")).alias("y"),
        F.coalesce(wide, F.get("widths", "col"), F.lit(COLUMN_PX)).alias("width"), "height", text.alias("text"), F.coalesce("stroke", F.lit("#000000")).alias("stroke"), F.col("fill"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def overlay(df: DataFrame, keys: list[str], lines: DataFrame, xml: str = "xml") -> DataFrame:
    """Glyphs of word boxes with the style of the nearest line of their page: ``keys, page_index, word_seq, glyph, text, x, y, width, height, font_size``.

    ``df`` holds word boxes by page, ``lines`` the pages' lines in their own space, of ``page_width`` and ``page_height``; sizes follow the pages' widths.
    """
    pages = xml_pages(df, keys, xml)
    on = [*keys, "page_index"]
    words = word_boxes(pages.select(*on, "body"), on, "body")
    size = lines.groupBy(*on).agg(F.first("page_width").alias("w"), F.first("page_height").alias("h"))
    ratio = pages.join(size, on).select(*on, (F.col("width") / F.col("w")).alias("sx"), (F.col("height") / F.col("h")).alias("sy"))
    scaled = lines.join(ratio, on)
    for c, s in (("x", "sx"), ("y", "sy"), ("width", "sx"), ("height", "sy")):
        scaled = scaled.withColumn(c, F.col(c) * F.col(s))
    best = L.nearest_style(words, scaled, on)
    styled_ = words.join(best.join(scaled.select(*on, "line_seq", (F.col("font_size") * F.col("sx")).alias("size")), [*on, "line_seq"]).select(*on, "word_seq", "size"), [*on, "word_seq"], "left")
    glyphs = L.split_glyphs(styled_, [*on, "word_seq"])
    sizes = styled_.select(*on, "word_seq", "y", "height", F.greatest(F.lit(1.0), F.coalesce("size", F.col("height") * 0.9)).alias("font_size"))
    return glyphs.join(sizes, [*on, "word_seq"])

