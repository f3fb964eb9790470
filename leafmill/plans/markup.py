"""Queries on markup, archives, stores and deliveries: texts of these forms are made of table rows and read back."""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions import webhook as H
from leafmill.operators import accounts as A
from leafmill.operators import markdown as D
from leafmill.plans.layout import text_lines
from leafmill.sources import archives, markup, odf_shapes, stores, zip_directory
from leafmill.sources.scratch import scratch_path
from leafmill.sources.tables import PART, in_parts, table


def _tag(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def svgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for every part: its size in one of four ways, two rectangles of which one may have no area, two texts and an image."""
    k, s = F.col("p_partkey"), F.col("p_size")
    size = F.when(k % 4 == 0, _tag(' width="', s * 2, 'px" height="', s, '"')).when(k % 4 == 1, _tag(' viewBox="0 0 ', s * 3, " ", s, '.5"')).when(k % 4 == 2, _tag(' width="', s, '"')).otherwise(F.lit(""))
    svg = _tag("<svg", size, '><rect x="', k % 9, '" y="2" width="', k % 3, '" height="7" fill="#abc"/><rect x="1" width="4" height="5" stroke="red" stroke-width="2"/><text x="', k % 50, '" y="', k % 30, '" font-size="', k % 5, '">',
               F.col("p_brand"), '</text><TEXT fill="">', F.col("p_type"), "</TEXT><image xlink:href='data:image/", F.when(k % 2 == 0, "PNG").otherwise("jpeg"), ";base64,", F.base64(k.cast("string").cast("binary")), "'/></svg>")
    # A file of short rows is small, and so one task's: rows are dealt before pictures are made of them.
    parts = in_parts(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"), "p_partkey", "p_type", PART // 5)
    return parts.select("p_partkey", svg.alias("svg"))


def svg_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = markup.svg_size(F.col("svg"))
    return svgs(spark, sf_dir).select("p_partkey", F.round(w, 4).alias("width"), F.round(h, 4).alias("height"))


def svg_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.svg_glyphs(svgs(spark, sf_dir), ["p_partkey"])


def svg_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.svg_rects(svgs(spark, sf_dir), ["p_partkey"])


def svg_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.svg_images(svgs(spark, sf_dir), ["p_partkey"]).select("p_partkey", F.col("number").cast("long").alias("number"), "kind", F.col("content").cast("string").alias("content"))


def layout_xmls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of two pages for every supplier; the second page's size is missing, a font comes twice, lines may be blank or of an unknown font."""
    k = F.col("s_suppkey")
    line = lambda left, font, body: _tag('<text left="', left, '" top="', k % 40, '" width="', k % 3 * 50, '" height="', k % 2 * 11, '" font="', font, '">', body, "</text>")
    xml = _tag('<fontspec id="1" size="9" family="Old"/><fontspec id="1" size="', k % 20, '" family="', F.when(k % 2 == 0, "Arial").otherwise(""), '" color="#123456"/><page width="900" height="1200">',
               line(k % 60, "1", _tag("<b>", F.col("s_name"), "</b> &amp; co")), line(k % 70, "7", F.col("s_name")), line(k, "1", F.lit(" <i> </i> ")), '</page><page height="0">', line(k % 80, "1", F.lit("second&#65;")), "</page>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml"))


def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.xml_pages(layout_xmls(spark, sf_dir), ["s_suppkey"]).drop("body")


def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.xml_lines(layout_xmls(spark, sf_dir), ["s_suppkey"])


def word_xmls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of every supplier's name; one has no width, one no text, one no number."""
    k = F.col("s_suppkey")
    word = lambda x0, x1, body: _tag('<word xMin="', x0, '" yMin="', k % 9, '" xMax="', x1, '" yMax="', k % 9 + 12, '">', body, "</word>")
    xml = _tag('<page width="450" height="600">', word(k, k + k % 3 * 30, F.col("s_name")), word(k, k + 5, F.lit(" ")), word(F.lit("x"), k, F.lit("y")), word(k + 1, k + 21.5, F.lit("a&lt;b")), "</page>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml"))


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.word_boxes(word_xmls(spark, sf_dir), ["s_suppkey"], "xml")


def word_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of the word boxes, with the size of the nearest line of a page twice as large: counted, with the sum of their widths."""
    k = F.col("s_suppkey")
    one = lambda seq, y, size, text: F.struct(F.lit(seq).alias("line_seq"), text.alias("text"), F.lit(0.0).alias("x"), y.alias("y"), F.lit(900.0).alias("width"), F.lit(24.0).alias("height"), size.alias("font_size"))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0).alias("page_index"), F.explode(F.array(one(0, k % 9 * 2.0, k % 10 + 6.0, F.col("s_name")), one(1, F.lit(700.0), F.lit(40.0), F.lit("far")))).alias("l"))
    lines = lines.select("s_suppkey", "page_index", "l.*", F.lit(900.0).alias("page_width"), F.lit(1200.0).alias("page_height"))
    out = markup.overlay(word_xmls(spark, sf_dir), ["s_suppkey"], lines)
    return out.groupBy("s_suppkey", "word_seq").agg(F.count("*").alias("n"), F.round(F.sum("width"), 3).alias("width"), F.min("font_size").alias("font_size"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("glyph", "text"))), lambda g: g.text)).alias("text"))


def odfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ODF text for every supplier: styles, three paragraphs of which one is blank, and two tables."""
    k = F.col("s_suppkey")
    style = lambda name, family, props: _tag('<style:style style:name="', name, f'" style:family="{family}">', props, "</style:style>")
    cell = lambda attrs, body: _tag("<table:table-cell", attrs, "><text:p>", body, "</text:p></table:table-cell>")
    styles = [
        style("P1", "text", _tag('<style:text-properties fo:font-size="', k % 12 + 6, 'pt" fo:font-weight="', F.when(k % 2 == 0, "bold").otherwise("normal"), '" style:font-name="Arial"/>')),
        style("C1", "table-column", _tag('<style:table-column-properties style:column-width="', k % 5 + 1, 'in"/>')),
        style("R1", "table-row", _tag("<style:table-row-properties style:", F.when(k % 2 == 0, "row-height").otherwise("min-row-height"), '="', k % 60, 'px"/>')),
        style("X1", "table-cell", _tag('<style:table-cell-properties fo:background-color="', F.when(k % 3 == 0, "transparent").otherwise("#eeeeee"), '"', F.element_at(F.array(*map(F.lit, ("", ' fo:border="none"', ' fo:border-top="0.5pt solid #AA00bb"', ' fo:border="1pt dashed"'))), (k % 4 + 1).cast("int")), "/>")),
    ]
    first = _tag('<table:table table:name="a"><table:table-column table:style-name="C1" table:number-columns-repeated="2"/><table:table-column/><table:table-row table:style-name="R1">', cell(F.lit(' table:style-name="X1" table:number-columns-spanned="2"'), F.col("s_name")),
                 "<table:covered-table-cell/>", cell(F.lit(""), F.lit("x<text:tab/>y")), '</table:table-row><table:table-row><table:table-cell/>', cell(F.lit(' table:number-rows-spanned="2"'), k), "</table:table-row></table:table>")
    second = _tag("<table:table><table:table-row>", cell(F.lit(""), F.lit("only")), "</table:table-row></table:table>")
    xml = _tag(*styles, '<text:h text:style-name="P1">', F.col("s_name"), "</text:h><text:p> </text:p>", first, '<text:p text:style-name="none">a<text:s text:c="2"/>b</text:p>', second)
    return table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml"))


def odf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs outside tables with style and running height."""
    x = odfs(spark, sf_dir)
    out = markup.odf_paragraph_lines(x, ["s_suppkey"], markup.odf_styles(x, ["s_suppkey"]))
    return out.select("s_suppkey", "text", F.round("font_size", 4).alias("font_size"), "bold", "font_family", F.round("y", 4).alias("y"), F.round("height", 4).alias("height"))


def odf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markup.odf_tables(odfs(spark, sf_dir), ["s_suppkey"], 794.0)
    return out.select("s_suppkey", "table_seq", "row", "col", "row_span", "col_span", *(F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")), "text", "stroke", "fill")


def drawn_odfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ODF text for every supplier: graphic styles, a page layout for some, text frames, an image, a line and two shapes, one of them inside a table."""
    k = F.col("s_suppkey")
    style = lambda name, props: _tag('<style:style style:name="', name, '" style:family="graphic"><style:graphic-properties ', props, "/></style:style>")
    at = lambda x, y, w, h: _tag(' svg:x="', x, 'px" svg:y="', y, 'px" svg:width="', w, '" svg:height="', h, '"')
    layout = F.when(k % 3 == 0, _tag('<style:page-layout style:name="L"><style:page-layout-properties fo:page-width="', k % 7 + 4, 'in" fo:page-height="10in"/></style:page-layout>')).otherwise("")
    styles = _tag(
        layout, style("g", 'draw:stroke="none" draw:fill="solid" draw:fill-color="#abcdef"'), style("h", _tag('svg:stroke-color="#', F.lpad((k % 1000).cast("string"), 6, "0"), '"')), style("n", 'draw:stroke="none"'),
        '<style:style style:name="T" style:family="text"><style:text-properties fo:font-size="', k % 9 + 5, 'pt" fo:font-weight="bold"/></style:style>',
    )
    look = F.element_at(F.array(*map(F.lit, ("g", "h", "n"))), (k % 3 + 1).cast("int"))
    text = _tag('<draw:frame draw:style-name="', look, '" text:anchor-page-number="', k % 3, '"', at(k % 50, k % 40, "200px", "30px"), "><draw:text-box><text:p>", F.when(k % 2 == 0, _tag('<text:span text:style-name="T">', F.col("s_name"), "</text:span>")).otherwise(F.col("s_name")), "</text:p></draw:text-box></draw:frame>")
    blank = _tag('<draw:frame draw:style-name="g"', at("1", "2", "0px", "9px"), "><draw:text-box><text:p> </text:p></draw:text-box></draw:frame>")
    image = _tag('<draw:frame text:anchor-page-number="2"', at("3", "4", "1in", _tag(k % 90, "px")), '><draw:image xlink:href="Pictures/', k, F.when(k % 2 == 0, ".jpg").otherwise(""), '"/></draw:frame>')
    line = _tag('<draw:line draw:style-name="', look, '" svg:x1="', k % 90, 'px" svg:y1="20px" svg:x2="', k % 60, 'px" svg:y2="20px"><text:p/></draw:line>')
    shape = _tag('<draw:polygon draw:style-name="', look, '"', at(k % 5, "6", "50px", "60px"), "></draw:polygon>")
    hidden = _tag("<table:table><table:table-row>", _tag('<draw:rect draw:style-name="g"', at("0", "0", "9px", "9px"), "></draw:rect>"), "</table:table-row></table:table>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", _tag(styles, text, blank, image, line, hidden, shape).alias("xml"))


def odf_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odf_shapes.odf_boxes(drawn_odfs(spark, sf_dir), ["s_suppkey"])


def odf_frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odf_shapes.odf_frame_lines(drawn_odfs(spark, sf_dir), ["s_suppkey"]).withColumn("font_size", F.round("font_size", 4))


def odf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odf_shapes.odf_images(drawn_odfs(spark, sf_dir), ["s_suppkey"])


def odf_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = odf_shapes.odf_page_size(F.col("xml"))
    return drawn_odfs(spark, sf_dir).select("s_suppkey", F.round(width, 3).alias("width"), F.round(height, 3).alias("height"))


def _packed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Documents as archives of two parts, every seventh one broken."""

    def zipped(text: str) -> bytes:
        a, b = text[: len(text) // 2], text[len(text) // 2 :]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            if kind == "epub":
                z.writestr("META-INF/container.xml", '<c><rootfile full-path="O/p.opf"/></c>')
                z.writestr("O/p.opf", '<p><item id="a" href="x%20y.xhtml#f" media-type="application/xhtml+xml"/><item id="b" href="../z.html" media-type="text/html"/><item id="i" href="i.png" media-type="image/png"/><itemref idref="b"/><itemref idref="i"/><itemref idref="a"/><itemref idref="n"/></p>')
                z.writestr("O/x y.xhtml", b)
                z.writestr("z.html", a)
            else:
                spelled = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("\n", " ")
                for name, t in (("section10", a), ("section2", b)):
                    z.writestr(f"Contents/{name}.xml", f'<s xmlns:hp="x"><hp:p><hp:t>{spelled(t)}</hp:t><hp:t>!</hp:t></hp:p></s>')
        return out.getvalue()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            content = [b"broken" if i % 7 == 0 else zipped(t) for i, t in zip(part["doc_id"], part["text"])]
            yield pd.DataFrame({"path": part["doc_id"].astype(str), "content": content})

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(run, "path string, content binary")


def _digested(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").cast("long").alias("doc_id"), "place", "part", F.md5(F.col("text").cast("binary")).alias("md5"), "skipped")


def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(archives.unpacked(_packed(spark, sf_dir, "epub"), "epub"))


def hwpx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(archives.unpacked(_packed(spark, sf_dir, "hwpx"), "hwpx"))


#: Names of the parts of the archives below, by kind.
_ARCHIVES = (("[Content_Types].xml", "word/document.xml"), ("mimetype", "Contents/section0.xml"), ("META-INF/container.xml", "O/ch.xhtml"), ("content.xml", "META-INF/manifest.xml"), ("a.txt", "b.txt"))


def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an archive of its two halves, of one of five kinds, some of them cut off; told apart by their central directories."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.expr("length(text) div 2")
    names = F.get(F.array(*(F.array(*map(F.lit, pair)) for pair in _ARCHIVES)), (F.col("doc_id") % len(_ARCHIVES)).cast("int"))
    part = lambda i, body: F.struct(F.get(names, F.lit(i)).alias("name"), F.encode(body, "UTF-8").alias("content"))
    parts = F.array(part(0, F.substr("text", F.lit(1), half)), part(1, F.substr("text", half + 1)))
    packed = docs.select("doc_id", zip_directory.zip_stored(parts).alias("whole"))
    content = F.when(F.col("doc_id") % 7 == 0, F.substr("whole", F.lit(1), F.length("whole") - 4)).otherwise(F.col("whole"))
    found = packed.select("doc_id", content.alias("content")).withColumn("end", zip_directory.end_record(F.col("content"))).withColumn("entries", zip_directory.entries(F.col("content"), F.col("end")))
    kind = zip_directory.archive_kind(F.transform("entries", lambda e: e["name"]))
    size = F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["size"])
    return found.select("doc_id", kind.alias("kind"), F.size("entries").alias("n_parts"), F.array_join(F.transform("entries", lambda e: e["name"]), ",").alias("names"), size.alias("size"), F.get("entries", F.lit(1))["offset"].alias("second"))


def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by their first bytes, and the sizes of pictures."""
    k = F.col("p_partkey")
    png = F.concat(F.lit("89504E470D0A1A0A0000000000000000"), F.lpad(F.hex(F.col("p_size").cast("long")), 8, "0"), F.lpad(F.hex(k.cast("long")), 8, "0"))
    head = F.when(k % 5 == 0, "D0CF11E0A1B11AE100").when(k % 5 == 1, "504B030414").when(k % 5 == 2, png).when(k % 5 == 3, "255044462D").otherwise("00")
    w, h = stores.png_size(F.col("c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.unhex(head).alias("c")).select("p_partkey", stores.sniff(F.col("c")).alias("kind"), w.alias("width"), h.alias("height"))


def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/job7/page-"), F.when(k % 6 == 0, "x").otherwise(k.cast("string")), F.lit("-12.png")).alias("path"))
    return stores.numbered(f).select("p_partkey", "number")


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text for every part: heading, list, quote, code, a table that a heading overtakes."""
    md = _tag("# ", F.col("p_name"), "\n- **", F.col("p_brand"), "**\n- `", F.col("p_size"), "`\n\n1. one\n> ", F.col("p_type"), "\n```sql\na < ", F.col("p_partkey"), "\n```\n| k | ", F.col("p_partkey"), " |\n|---|---|\n## late\nend")
    docs = in_parts(table(spark, sf_dir, "part").select("p_partkey", md.alias("md")), "p_partkey", "md")
    return D.markdown_html(docs, ["p_partkey"], "md")


def auth_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores of sessions and records, a hundred to a store, read back and joined by mail address."""
    k = F.col("s_suppkey")
    user = F.struct(k.cast("string").alias("id"), F.concat(F.lit("U"), k.cast("string"), F.lit("@x.kr")).alias("email"), F.col("s_name").alias("name"))
    session = F.struct(F.concat(F.lit("i"), k.cast("string")).alias("id"), user.alias("user"), (k * 1000).alias("createdAt"))
    record = F.struct((k % 4).cast("int").alias("oneTimePasses"), F.when(k % 2 == 0, "monthly").alias("plan"))
    s = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 100").alias("store"), F.struct(session.id.alias("key"), session.alias("value")).alias("s"), F.struct(F.concat(F.lit("u"), k.cast("string"), F.lit("@x.kr")).alias("key"), record.alias("value")).alias("p"))
    store = s.groupBy("store").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("s")).alias("sessions"), F.map_from_entries(F.collect_list("p")).alias("premiumByEmail"))).alias("value"))
    path = scratch_path(spark, "store")
    store.select("value").write.text(path)
    t = stores.auth_store(spark, path, lines=True)
    mine = t["sessions"].select(A.email_key(F.col("user.email")).alias("email"), F.col("user.name").alias("name"), "createdAt")
    return mine.join(t["premium"].select("email", "oneTimePasses", "plan"), "email")


def usage_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user's last day as stores of a hundred users, read back."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").cast("int").alias("n"))
    last = e.groupBy("user_id").agg(F.max(F.struct("day", "n")).alias("l")).select(F.expr("user_id div 100").alias("store"), F.struct(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.struct(F.col("l.n").alias("count"), F.col("l.day").cast("string").alias("date")).alias("value")).alias("e"))
    path = scratch_path(spark, "usage")
    last.groupBy("store").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).select("value").write.text(path)
    return stores.usage_store(spark, path, lines=True)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log, read back."""
    path = scratch_path(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    stores.append_log(e.where("event_id % 2 = 0"), path)
    stores.append_log(e.where("event_id % 2 = 1"), path)
    return stores.read_log(spark, path, "event_id bigint, user_id bigint, event_type string")


def layout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as layout JSON, written and read with its schema: lines with their boxes."""
    n = text_lines(spark, sf_dir).withColumn("page", F.expr("line_seq div 50"))
    line = F.struct("line_seq", "text", "x", "y", "width", "height")
    pages = n.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(line)).alias("l"))
    lines = F.transform("l", lambda q: F.struct(*(q[c].alias(c) for c in ("text", "x", "y", "width", "height")), (q.y + 9).alias("baseline")))
    boxes = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.size("l").cast("double").alias("width"), F.lit(9.0).alias("height"), F.lit("#000000").alias("stroke")))
    page = F.struct("page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), lines.alias("lines"), boxes.alias("boxes"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages")).withColumn("unit", F.lit("pt"))
    path = scratch_path(spark, "layout")
    stores.write_layouts(docs, path)
    t = stores.layouts(spark, path)
    per = t["lines"].groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("baseline").alias("low"))
    return per.join(t["boxes"].select("doc_id", "page_index", F.col("width").alias("box")), ["doc_id", "page_index"]).join(t["pages"].select("doc_id", "page_index", "unit", F.col("width").alias("page_width")), ["doc_id", "page_index"])


_SECRET = "whsec_" + base64.b64encode(b"a key of the tests").decode()


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deliveries: address and product stand in other places of the body each time; some bodies are broken."""
    k = F.col("o_orderkey")
    mail = _tag('"c', F.col("o_custkey"), '@x.kr"')
    at = F.element_at(F.array(*map(F.lit, ("order.paid", "subscription.canceled", "subscription.revoked", "other"))), (k % 4 + 1).cast("int"))
    data = F.when(k % 5 == 0, _tag('{"product": {"id": "p', k % 3, '"}, "customer": {"email": ', mail, "}}")).when(k % 5 == 1, _tag('{"productId": "p', k % 3, '", "customerEmail": ', mail, ', "expiresAt": "2026-01-01T00:00:00+00:00"}'))
    data = data.when(k % 5 == 2, _tag('{"products": [{"x": 1}, {"product_id": "p', k % 3, '"}], "a": [{"email": "none"}, {"email": ', mail, "}]}")).otherwise(_tag('{"deep": {"items": [{"product_id": "p', k % 3, '"}]}, "user": {"customer_email": ', mail, "}}"))
    body = F.when(k % 11 == 0, F.lit("{")).otherwise(_tag('{"type": "', at, '", "data": ', data, "}"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), body.alias("body"))


def webhook_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("k", H.purchase(F.col("body")).alias("p")).select("k", "p.*")


def webhook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries signed here, every third body changed afterwards."""

    @F.pandas_udf("string")
    def sign(ids: pd.Series, at: pd.Series, body: pd.Series) -> pd.Series:
        key = base64.b64decode(_SECRET.removeprefix("whsec_"))
        return pd.Series(["v1,other v1," + H.signature(key, i, t, b) for i, t, b in zip(ids, at, body)])

    k = F.col("k")
    d = _bodies(spark, sf_dir).select("k", k.cast("string").alias("id"), (k * 7).cast("string").alias("at"), "body")
    d = d.withColumn("header", sign("id", "at", "body")).withColumn("body", F.when(k % 3 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return d.select("k", H.signed(_SECRET, F.col("id"), F.col("at"), F.col("body"), F.col("header")).alias("valid"))


def stream_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries as envelopes in a folder, read as a stream: once each, routed by type, counted by outcome."""
    folder, out = scratch_path(spark, "deliveries"), scratch_path(spark, "routed")
    b = _bodies(spark, sf_dir).select((F.col("k") % 500).cast("string").alias("delivery_id"), F.lit("0").alias("sent"), F.lit("").alias("signature"), F.when(F.col("k") % 11 == 0, F.lit("{}")).otherwise(F.col("body")).alias("body"))
    b = b.withColumn("body", F.concat(F.lit('{"type": "'), A.event_type(F.col("body")), F.lit('"}')))
    b.write.json(folder)
    s = stores.deliveries(spark, folder).select("delivery_id", A.event_type(F.col("body")).alias("kind")).select("delivery_id", A.route(F.col("kind")).alias("outcome")).dropDuplicates(["delivery_id", "outcome"])
    q = s.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("delivery_id string, outcome string").parquet(f"{out}/rows").groupBy("outcome").agg(F.count("*").alias("n"))


def form_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a form feed for every fourth line's break, as pages."""
    t = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(s, F.when(i % 4 == 3, "\f").otherwise("\n"))), "")
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.form_feed_pages(t)).alias("page", "text"))
    return p.select("doc_id", "page", F.length("text").cast("long").alias("chars"))


def escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.escape_html(F.col("html")).cast("binary")).alias("md5"))


_SVG_SQL = """svg AS (SELECT p_partkey AS k, p_size AS s, p_brand, p_type FROM part)"""
_SUP = "sup AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)"

QUERIES = {
    f.__name__: f
    for f in (
        svg_sizes, svg_glyphs, svg_rects, svg_images, xml_pages, xml_lines, word_boxes, word_overlay, odf_lines, odf_tables, epub_chapters, hwpx_paragraphs, archive_kinds, container_kinds, numbered_files, markdown_pages,
        odf_boxes, odf_frame_lines, odf_images, odf_page_sizes, auth_store, usage_store, audit_log, layout_scan, webhook_purchases, webhook_signatures, stream_webhooks, form_feeds, escaped_pages,
    )
}
SQL = {
    "svg_sizes": f"WITH {_SVG_SQL} SELECT k AS p_partkey, CAST(CASE k % 4 WHEN 0 THEN s * 2 WHEN 1 THEN s * 3 ELSE 793.7067 END AS DOUBLE) AS width, CAST(CASE k % 4 WHEN 0 THEN s WHEN 1 THEN s + 0.5 ELSE 1122.5067 END AS DOUBLE) AS height FROM svg",
    "svg_glyphs": f"""WITH {_SVG_SQL} SELECT k AS p_partkey, 0 AS seq, CAST(k % 50 AS DOUBLE) AS x, CAST(k % 30 AS DOUBLE) AS y, CAST(CASE WHEN k % 5 = 0 THEN 12 ELSE k % 5 END AS DOUBLE) AS font_size, '#000000' AS fill, 'Helvetica' AS font_family, '' AS font_weight, p_brand AS content FROM svg
      UNION ALL SELECT k, 1, 0.0, 0.0, 12.0, '#000000', 'Helvetica', '', p_type FROM svg""",
    "svg_rects": f"WITH {_SVG_SQL} SELECT k AS p_partkey, 0 AS seq, CAST(k % 9 AS DOUBLE) AS x, 2.0::DOUBLE AS y, CAST(k % 3 AS DOUBLE) AS width, 7.0::DOUBLE AS height, 0.0::DOUBLE AS stroke_width, '#abc' AS fill, NULL AS stroke FROM svg WHERE k % 3 > 0 UNION ALL SELECT k, 1, 1.0, 0.0, 4.0, 5.0, 2.0, NULL, 'red' FROM svg",
    "svg_images": f"WITH {_SVG_SQL} SELECT k AS p_partkey, 1 AS number, CASE WHEN k % 2 = 0 THEN 'png' ELSE 'jpg' END AS kind, CAST(k AS VARCHAR) AS content FROM svg",
    "xml_pages": f"WITH {_SUP} SELECT k AS s_suppkey, p AS page_index, CAST(CASE p WHEN 0 THEN 900 ELSE 892 END AS DOUBLE) AS width, CAST(CASE p WHEN 0 THEN 1200 ELSE 1262 END AS DOUBLE) AS height FROM sup, (VALUES (0), (1)) v(p)",
    "xml_lines": f"""WITH {_SUP}, l AS (SELECT k, 0 AS page_index, 0 AS line_seq, name || ' & co' AS text, k % 60 AS x, true AS known, true AS bold FROM sup UNION ALL SELECT k, 0, 1, name, k % 70, false, false FROM sup UNION ALL SELECT k, 1, 0, 'secondA', k % 80, true, false FROM sup)
      SELECT k AS s_suppkey, page_index, line_seq, text, CAST(x AS DOUBLE) AS x, CAST(k % 40 AS DOUBLE) AS y, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 * 50 END AS DOUBLE) AS width, CAST(CASE WHEN k % 2 = 0 THEN 12 ELSE 11 END AS DOUBLE) AS height,
        CASE WHEN known AND k % 2 = 0 THEN 'Arial' ELSE '함초롬바탕' END AS font_family, CAST(CASE WHEN NOT known THEN CASE WHEN k % 2 = 0 THEN 16 ELSE 11 END WHEN k % 20 = 0 THEN 12 ELSE k % 20 END AS DOUBLE) AS font_size, bold, CASE WHEN known THEN '#123456' ELSE '#000000' END AS color FROM l""",
    "word_boxes": f"WITH {_SUP} SELECT k AS s_suppkey, 0 AS word_seq, name AS text, CAST(k AS DOUBLE) AS x, CAST(k % 9 AS DOUBLE) AS y, CAST(k % 3 * 30 AS DOUBLE) AS width, 12.0::DOUBLE AS height FROM sup WHERE k % 3 > 0 UNION ALL SELECT k, 3, 'a<b', k + 1, k % 9, 20.5, 12 FROM sup",
    "word_overlay": f"""WITH {_SUP}, w AS (SELECT k, 0 AS word_seq, name AS text, CAST(k % 3 * 30 AS DOUBLE) AS width FROM sup WHERE k % 3 > 0 UNION ALL SELECT k, 3, 'a<b', 20.5 FROM sup)
      SELECT k AS s_suppkey, word_seq, len(text) AS n, round(width, 3) AS width, (k % 10 + 6) / 2.0::DOUBLE AS font_size, text FROM w""",
    "odf_lines": f"""WITH {_SUP} SELECT k AS s_suppkey, name AS text, CAST(k % 12 + 6 AS DOUBLE) AS font_size, k % 2 = 0 AS bold, 'Nimbus Sans' AS font_family, 72.0::DOUBLE AS y, round(greatest(12.0::DOUBLE, (k % 12 + 6) * 1.4::DOUBLE), 4) AS height FROM sup
      UNION ALL SELECT k, 'a  b', 12.0, false, '함초롬바탕', round(72 + greatest(12.0::DOUBLE, (k % 12 + 6) * 1.4::DOUBLE), 4), 16.8 FROM sup""",
    "odf_tables": f"""WITH {_SUP}, s AS (SELECT k, name, (k % 5 + 1) * 96.0::DOUBLE AS w, greatest(18.0::DOUBLE, CASE WHEN k % 60 = 0 THEN 28.0::DOUBLE ELSE CAST(k % 60 AS DOUBLE) END) AS h FROM sup), l AS (SELECT *, greatest(0.0::DOUBLE, (794 - 2 * w - 96) / 2) AS x0 FROM s),
      c AS (SELECT k, 0 AS t, 0 AS r, 0 AS c, 1 AS rs, 2 AS cs, x0 AS x, 72.0::DOUBLE AS y, 2 * w AS width, h AS height, name AS text, CASE WHEN k % 3 <> 0 THEN '#eeeeee' END AS fill, CASE WHEN k % 4 = 2 THEN '#AA00bb' ELSE '#000000' END AS stroke FROM l UNION ALL SELECT k, 0, 0, 3, 1, 1, x0 + 2 * w + 96, 72, 96, h, 'x' || chr(9) || 'y', NULL, '#000000' FROM l
        UNION ALL SELECT k, 0, 1, 0, 1, 1, x0, 72 + h, w, 28, '', NULL, '#000000' FROM l UNION ALL SELECT k, 0, 1, 1, 2, 1, x0 + w, 72 + h, w, 28, CAST(k AS VARCHAR), NULL, '#000000' FROM l UNION ALL SELECT k, 1, 0, 0, 1, 1, 72, 72 + h + 28 + 10, 650, 28, 'only', NULL, '#000000' FROM l)
      SELECT k AS s_suppkey, t AS table_seq, r AS row, c AS col, rs AS row_span, cs AS col_span, round(x, 4) AS x, round(y, 4) AS y, round(width, 4) AS width, round(height, 4) AS height, text, stroke, fill FROM c""",
    "odf_boxes": f"""WITH {_SUP} SELECT k AS s_suppkey, greatest(1, CAST(k % 3 AS INT)) AS page, 'frame' AS kind, 0 AS seq, CAST(k % 50 AS DOUBLE) AS x, CAST(k % 40 AS DOUBLE) AS y, 200.0::DOUBLE AS width, 30.0::DOUBLE AS height, CASE k % 3 WHEN 1 THEN '#' || lpad(CAST(k % 1000 AS VARCHAR), 6, '0') END AS stroke, CASE k % 3 WHEN 0 THEN '#abcdef' END AS fill FROM sup WHERE k % 3 < 2
      UNION ALL SELECT k, 1, 'frame', 1, 1, 2, 1, 9, NULL, '#abcdef' FROM sup
      UNION ALL SELECT k, 1, 'line', 0, least(k % 90, k % 60), 20, greatest(1, abs(k % 90 - k % 60)), 1, CASE k % 3 WHEN 1 THEN '#' || lpad(CAST(k % 1000 AS VARCHAR), 6, '0') ELSE '#000000' END, NULL FROM sup
      UNION ALL SELECT k, 1, 'shape', 0, k % 5, 6, 50, 60, CASE k % 3 WHEN 1 THEN '#' || lpad(CAST(k % 1000 AS VARCHAR), 6, '0') END, CASE k % 3 WHEN 0 THEN '#abcdef' END FROM sup WHERE k % 3 < 2""",
    "odf_frame_lines": f"""WITH {_SUP} SELECT k AS s_suppkey, greatest(1, CAST(k % 3 AS INT)) AS page, 0 AS seq, name AS text, CAST(k % 50 AS DOUBLE) AS x, CAST(k % 40 AS DOUBLE) AS y, 200.0::DOUBLE AS width, 30.0::DOUBLE AS height, '함초롬바탕' AS font_family, CASE WHEN k % 2 = 0 THEN CAST(k % 9 + 5 AS DOUBLE) ELSE 21.6::DOUBLE END AS font_size, k % 2 = 0 AS bold, '#000000' AS color FROM sup""",
    "odf_images": f"""WITH {_SUP} SELECT k AS s_suppkey, 2 AS page, 2 AS seq, CASE WHEN k % 2 = 0 THEN 'odt-image-1.jpg' ELSE 'odt-image-1.png' END AS id, 'Pictures/' || k || CASE WHEN k % 2 = 0 THEN '.jpg' ELSE '' END AS href, 3.0::DOUBLE AS x, 4.0::DOUBLE AS y, 96.0::DOUBLE AS width, CAST(greatest(1, k % 90) AS DOUBLE) AS height, 96 AS natural_w, CAST(greatest(1, k % 90) AS INT) AS natural_h FROM sup""",
    "odf_page_sizes": f"""WITH {_SUP} SELECT k AS s_suppkey, CASE WHEN k % 3 = 0 THEN (k % 7 + 4) * 96.0::DOUBLE ELSE 793.738::DOUBLE END AS width, CASE WHEN k % 3 = 0 THEN 960.0::DOUBLE ELSE 1122.518::DOUBLE END AS height FROM sup""",
    "epub_chapters": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, len(coalesce(text, '')) // 2 AS h FROM documents)
      SELECT doc_id, 0 AS place, 'z.html' AS part, md5(substr(t, 1, h)) AS md5, NULL AS skipped FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 1, 'O/i.png', NULL, 'unsupported media type' FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 2, 'O/x y.xhtml', md5(substr(t, h + 1)), NULL FROM d WHERE doc_id % 7 <> 0
      UNION ALL SELECT doc_id, 3, NULL, NULL, 'missing manifest item' FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 0, NULL, NULL, 'unreadable: BadZipFile' FROM d WHERE doc_id % 7 = 0""",
    "hwpx_paragraphs": """WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS t, len(coalesce(text, '')) // 2 AS h FROM documents)
      SELECT doc_id, 0 AS place, 'Contents/section10.xml' AS part, md5(substr(t, 1, h) || '!') AS md5, NULL AS skipped FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 1, 'Contents/section2.xml', md5(substr(t, h + 1) || '!'), NULL FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 0, NULL, NULL, 'unreadable: BadZipFile' FROM d WHERE doc_id % 7 = 0""",
    "archive_kinds": f"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, k, t, len(t) // 2 AS h, [{', '.join('[' + ', '.join(f"'{n}'" for n in pair) + ']' for pair in _ARCHIVES)}][k + 1] AS names FROM d)
      SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN ['docx', 'hwpx', 'epub', 'odf', 'zip'][k + 1] END AS kind, CASE WHEN doc_id % 7 <> 0 THEN 2 END AS n_parts, CASE WHEN doc_id % 7 <> 0 THEN array_to_string(names, ',') END AS names,
        CASE WHEN doc_id % 7 <> 0 THEN CAST(strlen(t) AS BIGINT) END AS size, CASE WHEN doc_id % 7 <> 0 THEN CAST(30 + strlen(names[1]) + strlen(substr(t, 1, h)) AS BIGINT) END AS second FROM n""",
    "container_kinds": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ole' WHEN 1 THEN 'zip' WHEN 2 THEN 'png' WHEN 3 THEN 'pdf' END AS kind, CASE WHEN p_partkey % 5 = 2 THEN p_size END AS width, CASE WHEN p_partkey % 5 = 2 THEN CAST(p_partkey AS INT) END AS height FROM part",
    "numbered_files": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 6 = 0 THEN 12 ELSE p_partkey END AS INT) AS number FROM part",
    "markdown_pages": """SELECT p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<ul>' || chr(10) || '<li><strong>' || p_brand || '</strong></li>' || chr(10) || '<li><code>' || p_size || '</code></li>' || chr(10) || '</ul>' || chr(10) || chr(10) || '<ol>' || chr(10) || '<li>one</li>' || chr(10) || '</ol>' || chr(10)
      || '<blockquote>' || p_type || '</blockquote>' || chr(10) || '<pre><code class="language-sql">' || chr(10) || 'a &lt; ' || p_partkey || chr(10) || '</code></pre>' || chr(10) || '<h2>late</h2>' || chr(10) || '<table><tr><td>k</td><td>' || p_partkey || '</td></tr></table>' || chr(10) || '<p>end</p>' AS html FROM part""",
    "auth_store": "SELECT 'u' || s_suppkey || '@x.kr' AS email, s_name AS name, s_suppkey * 1000 AS createdAt, CAST(s_suppkey % 4 AS INT) AS oneTimePasses, CASE WHEN s_suppkey % 2 = 0 THEN 'monthly' END AS plan FROM supplier",
    "usage_store": "SELECT 'k' || user_id AS key, CAST(n AS INT) AS count, CAST(day AS VARCHAR) AS date FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1",
    "audit_log": "SELECT event_id, user_id, event_type FROM events",
    "layout_scan": """WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), p AS (SELECT doc_id, i // 50 AS page, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS chars, max(i * 4.0::DOUBLE + 9) AS low FROM l WHERE t <> '' GROUP BY 1, 2)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INT) AS page_index, n, chars, low, CAST(n AS DOUBLE) AS box, 'pt' AS unit, 595.0::DOUBLE AS page_width FROM p""",
    "webhook_purchases": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN 'c' || o_custkey || '@x.kr' END AS email, CASE WHEN o_orderkey % 11 <> 0 THEN 'p' || (o_orderkey % 3) END AS product_id, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 1 THEN '2026-01-01T00:00:00+00:00' END AS expires_at FROM orders",
    "webhook_signatures": "SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS valid FROM orders",
    "stream_webhooks": "SELECT outcome, count(DISTINCT id) AS n FROM (SELECT o_orderkey % 500 AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'ignored' ELSE ['grant', 'lifecycle', 'cancel', 'ignored'][o_orderkey % 4 + 1] END AS outcome FROM orders) GROUP BY 1",
    "form_feeds": r"""WITH l AS (SELECT doc_id, (generate_subscripts(a, 1) - 1) // 4 AS g, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), p AS (SELECT doc_id, g, trim(string_agg(t, chr(10) ORDER BY i), ' ' || chr(10) || chr(9)) AS t FROM l GROUP BY 1, 2)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS page, len(t) AS chars FROM p WHERE t <> ''""",
    "escaped_pages": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS md5 FROM pages",
}
