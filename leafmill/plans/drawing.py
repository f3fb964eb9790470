"""Queries on drawings, page geometry, page lists and settings; parts, suppliers and text lines stand in for what lies on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import accounts as A
from leafmill.operators import documents as D
from leafmill.operators import drawing as G
from leafmill.operators import layout as L
from leafmill.operators import pages as P
from leafmill.plans.layout import _LINES, _PAGES, doc_pages, text_lines
from leafmill.sources.tables import table


def _drawings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A drawing for every part on its brand's page, with three items each: kinds and sizes follow the key."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select("p_brand", k.alias("drawing_seq"), k.alias("k"), s.alias("s"))
    x, y = (F.col("k") % 50 * 10.0), (F.col("k") % 70 * 8.0)
    fill, stroke = F.when(F.col("k") % 4 == 0, "#DDDDDD"), F.when(F.col("k") % 3 == 0, "#333333")
    width = F.when(F.col("k") % 5 == 0, F.col("k") % 4 * 0.5)
    d = p.select("p_brand", "drawing_seq", x.alias("x0"), y.alias("y0"), (x + F.col("s") / 4).alias("x1"), (y + F.col("s") / 8).alias("y1"), stroke.alias("stroke"), fill.alias("fill"), width.alias("stroke_width"))
    i = p.withColumn("item_seq", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("r", (F.col("k") + F.col("item_seq")) % 7)
    op = F.when(F.col("r") < 2, "re").when(F.col("r") < 5, "l").when(F.col("r") == 5, "c").otherwise("h")
    x1 = F.when(F.col("r") == 3, x).otherwise(x + F.col("s") / 10)
    y1 = F.when(F.col("r") == 2, y + 0.25).otherwise(y + F.col("s") / 20)
    return d, i.select("p_brand", "drawing_seq", "item_seq", op.alias("op"), x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def drawing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = _drawings(spark, sf_dir)
    return G.drawing_boxes(i, d, ["p_brand"])


def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from whole drawings."""
    d, _ = _drawings(spark, sf_dir)
    return G.vector_page(d, d.select("p_brand", F.lit("").alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height")), ["p_brand"])[0]


def text_on_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts whose middle lies on a filled drawing of their brand's page."""
    d, _ = _drawings(spark, sf_dir)
    n = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("text"), (F.col("p_partkey") % 51 * 10.0).alias("x"), (F.col("p_partkey") % 71 * 8.0).alias("y"), F.lit(4.0).alias("width"), F.lit(2.0).alias("height"))
    return G.vector_page(d, n, ["p_brand"])[1].select("p_brand", "p_partkey", "text")


def line_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their origins: several of one text and nearly one height, the last counts; some have none."""
    n = text_lines(spark, sf_dir).select("doc_id", "line_seq", "text", (F.col("y") + F.col("line_seq") % 3 * 0.03).alias("y"))
    o = n.where("line_seq % 4 <> 3").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"), "line_seq", F.concat(F.lit(" "), "text").alias("text"), "y")
    o = o.select("doc_id", (F.col("line_seq") * 2 + F.col("k")).alias("seq"), "text", F.bround("y", 1).alias("y"), (F.col("y") + 9 + F.col("k")).alias("origin_y"))
    out = G.with_origin(n, o, ["doc_id"])
    return out.select("doc_id", "line_seq", F.round("origin_y", 4).alias("origin_y"))


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines, tops and heights of part names by metrics that are missing here and there."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select("p_partkey", (k % 90 * 7.0).alias("y0"), (k % 90 * 7.0 + 11).alias("y1"), s.alias("size"), F.when(k % 3 > 0, k % 3 * 50.0 - 50).alias("origin"), F.when(k % 5 > 0, (k % 5 - 1) * 0.3).alias("up"), F.when(k % 7 > 0, (k % 7 - 1) * -0.1).alias("down"))
    base, top, height = G.line_metrics(*(F.col(c) for c in ("y0", "y1", "size", "origin", "up", "down")))
    return p.select("p_partkey", F.round(base, 4).alias("baseline"), F.round(top, 4).alias("top"), F.round(height, 4).alias("height"))


def _rects(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    k = F.col("p_partkey")
    w = F.when(k % 6 == 0, 0.5).otherwise(F.col("p_size") / 2)
    return table(spark, sf_dir, "part").select("p_brand", k.alias(name), (k % 40 * 15.0).alias("x0"), (k % 60 * 12.0).alias("y0"), (k % 40 * 15.0 + w).alias("x1"), (k % 60 * 12.0 + F.col("p_size") / 3).alias("y1"))


def image_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of their brand's page: every tenth is a table instead, every ninth a text."""
    r = _rects(spark, sf_dir, "image_seq")
    images, tables = r.where("image_seq % 10 <> 0 and image_seq % 9 <> 0"), r.where("image_seq % 10 = 0")
    texts = r.where("image_seq % 9 = 0").select("p_brand", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return G.flagged_images(images, tables, texts, ["p_brand"]).select("p_brand", "image_seq", "behind")


def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column ends of a table for each brand: how many, and the widest step."""
    e = G.cell_edges(_rects(spark, sf_dir, "cell_seq"), ["p_brand"], "x0", "x1")
    return e.select("p_brand", F.size("edges").cast("long").alias("n"), F.round(F.array_max("steps"), 4).alias("widest"))


def table_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tables behind every seventh line of a document may begin."""
    n = text_lines(spark, sf_dir)
    t = n.where("line_seq % 7 = 0").select("doc_id", F.expr("line_seq div 7").alias("table_seq"), "line_seq")
    return G.leading_bottom(n, t, ["doc_id"]).select("doc_id", "table_seq", "y")


def stamp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents that are stamped: all of every third document, the first and the third of the others."""
    p = doc_pages(spark, sf_dir).withColumn("asked", F.when(F.col("doc_id") % 3 == 0, F.from_json(F.lit("[]"), "array<int>")).otherwise(F.array(F.lit(1), F.lit(3), F.lit(9999))))
    return G.stamped(p, F.col("asked")).select("doc_id", "page_index")


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    i = table(spark, sf_dir, "part").select("p_brand", k.alias("file_seq"), F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "image/gif"))), (k % 3 + 1).cast("int")).alias("kind"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 7).alias("height"))
    return G.image_pages(i, "p_brand").select("p_brand", "file_seq", F.col("page_index").cast("long").alias("page_index"), "width", "height")


def contents_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contents_preview(text_lines(spark, sf_dir), ["doc_id"])


def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: orders are files in their customer's folder."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return G.newest(o, "o_custkey", "path", "at")


def page_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = G.page_point((k % 400).cast("double"), (k % 300).cast("double"), F.lit(400.0), F.lit(300.0), F.lit(595.0), F.lit(842.0))
    return table(spark, sf_dir, "part").select("p_partkey", x.cast("long").alias("x"), y.cast("long").alias("y"))


def watermark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a watermark on each document's first page."""
    across, up = L.tiles(595.0, 842.0, 150.0, 120.5)
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(across).alias("x"), up.alias("u"))
    return d.select("doc_id", "x", F.explode("u").alias("y")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no table cell repeats: every third line stands in a cell again, some of them too far off."""
    n = text_lines(spark, sf_dir)
    c = n.where("line_seq % 3 = 0").select("doc_id", F.concat(F.lit(" "), "text").alias("text"), F.col("x"), (F.col("y") + F.when(F.col("line_seq") % 2 == 0, 0.0).otherwise(40.0)).alias("y"), "width", "height")
    return L.without_table_text(n, c, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_seq").alias("first"))


def kept_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 == 0, 600.0).otherwise(F.col("p_size") / 10).alias("width"), F.when(k % 11 == 0, 850.0).otherwise(F.col("p_size") / 5).alias("height"), F.element_at(F.array(F.lit("#ffffff"), F.lit(None), F.lit("#112233"), F.lit("#FFFFFE")), (k % 4 + 1).cast("int")).alias("fill"))
    return D.kept_fills(b, 595.0, 842.0).select("p_partkey")


def visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each supplier where wide and tall cells cover those behind them."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3))))
    wide = ((F.col("row") + F.col("s_suppkey")) % 4 == 0) & (F.col("col") == 0)
    tall = (F.col("col") == 3) & (F.col("row") % 2 == F.col("s_suppkey") % 2)
    c = s.select("s_suppkey", "row", "col", F.when(tall, 2).otherwise(1).alias("row_span"), F.when(wide, 3).otherwise(1).alias("col_span"))
    return D.visible_cells(c, ["s_suppkey"]).select("s_suppkey", "row", "col")


def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.regexp_replace("p_name", " ", "."), F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".pdf.pdf", "pdf"))), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", D.result_name(name, "pdf", "docx").alias("name"))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    data = F.when(k % 3 == 0, F.array(F.col("p_name"))).when(k % 3 == 1, F.array(F.col("p_name"), F.lit(None))).otherwise(F.array("p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(D.merged_row(data), F.lit(False)).alias("merged"))


def media_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image placeholders of each brand with the first medium of their name."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    blocks = p.select("p_brand", k.alias("seq"), F.when(k % 4 == 0, "plain").otherwise(F.concat(F.lit("[이미지: m"), (k % 9).cast("string"), F.lit("]"))).alias("text"))
    media = p.where("p_partkey % 9 < 7").select("p_brand", k.alias("media_seq"), F.concat(F.lit("m"), (k % 9).cast("string")).alias("id"), F.col("p_size").alias("natural_w"), (k % 100).cast("int").alias("natural_h"))
    return D.media_of(blocks, media, ["p_brand"]).select("p_brand", "seq", "id", "natural_w", "natural_h")


def range_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(F.lit("1-3, 5"), F.lit("2-"), F.lit(" 7 - 9 ,1"), F.lit("a"), F.lit(""), F.concat(k.cast("string"), F.lit(",")), k.cast("string")), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.rlike(P.RANGES).alias("valid"))


def product_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a purchase of a product by its number: two are on the lists, all others grant nothing. Counted by what they grant."""
    product = F.concat(F.lit("p"), (F.col("event_id") % 10).cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", A.granted(product, ["p1"], ["p2", "p3"]).alias("grants"))
    return e.groupBy("user_id", "grants").agg(F.count("*").alias("n"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUID and placeholder tests over values derived from every event."""
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("event_id") % 8
    v = F.when(k == 0, uuid).when(k == 1, F.concat(F.lit("  "), F.upper(uuid))).when(k == 2, F.concat(uuid, F.lit("0"))).when(k == 3, "00000000-0000-0000-0000-000000000000").when(k == 4, "sk-XXxxXX").when(k == 5, F.concat(F.lit("your-"), "event_type")).when(k == 6, " ").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return e.select("event_id", A.is_uuid(F.col("v")).alias("uuid"), A.is_placeholder(F.col("v"), ("click",)).alias("placeholder"))


def email_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lower(F.regexp_replace("c_name", "[# ]", "")), F.lit("@x.kr"))).when(k % 4 == 1, F.concat("c_name", F.lit("@x"))).when(k % 4 == 2, F.concat(F.lit("a b@x.kr"), "c_name")).otherwise(F.concat(F.lit("a@b@x.kr"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", A.is_email(v).alias("valid"))


_D = """p AS (SELECT p_brand, p_partkey AS k, CAST(p_size AS DOUBLE) AS s FROM part),
d AS (SELECT p_brand, k AS drawing_seq, k % 50 * 10.0::DOUBLE AS x0, k % 70 * 8.0::DOUBLE AS y0, k % 50 * 10.0::DOUBLE + s / 4 AS x1, k % 70 * 8.0::DOUBLE + s / 8 AS y1, CASE WHEN k % 3 = 0 THEN '#333333' END AS s0, CASE WHEN k % 4 = 0 THEN '#DDDDDD' END AS fill,
  CASE WHEN k % 5 = 0 THEN k % 4 * 0.5::DOUBLE END AS sw FROM p), dd AS (SELECT *, CASE WHEN fill IS NULL AND s0 IS NULL THEN '#000000' ELSE s0 END AS stroke FROM d),
i AS (SELECT p_brand, k AS drawing_seq, CAST(n AS INT) AS item_seq, CASE WHEN (k + n) % 7 < 2 THEN 're' WHEN (k + n) % 7 < 5 THEN 'l' WHEN (k + n) % 7 = 5 THEN 'c' ELSE 'h' END AS op, k % 50 * 10.0::DOUBLE AS ix0, k % 70 * 8.0::DOUBLE AS iy0,
  CASE WHEN (k + n) % 7 = 3 THEN k % 50 * 10.0::DOUBLE ELSE k % 50 * 10.0::DOUBLE + s / 10 END AS ix1, CASE WHEN (k + n) % 7 = 2 THEN k % 70 * 8.0::DOUBLE + 0.25::DOUBLE ELSE k % 70 * 8.0::DOUBLE + s / 20 END AS iy1 FROM p, range(3) r(n))"""
_KEEP = "(w > 0 AND h > 0 AND (w >= 5 AND h >= 0.3::DOUBLE OR h >= 5 AND w >= 0.3::DOUBLE OR w >= 1 AND h >= 1))"
_R = "r AS (SELECT p_brand, p_partkey AS k, p_partkey % 40 * 15.0::DOUBLE AS x0, p_partkey % 60 * 12.0::DOUBLE AS y0, p_partkey % 40 * 15.0::DOUBLE + CASE WHEN p_partkey % 6 = 0 THEN 0.5::DOUBLE ELSE p_size / 2.0::DOUBLE END AS x1, p_partkey % 60 * 12.0::DOUBLE + p_size / 3.0::DOUBLE AS y1 FROM part)"
_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"

QUERIES = {
    f.__name__: f
    for f in (
        drawing_boxes, drawn_boxes, text_on_fills, line_origins, line_metrics, image_overlaps, cell_edges, table_starts, stamp_pages, image_pages, contents_preview, newest_file, page_points, watermark_tiles,
        line_duplicates, kept_fills, visible_cells, result_names, merged_rows, media_places, range_syntax, product_grants, settings, email_shapes,
    )
}
SQL = {
    "drawing_boxes": f"""WITH {_D}, j AS (SELECT i.*, dd.stroke, dd.fill, dd.sw, greatest(CASE WHEN coalesce(sw, 0) = 0 THEN 0.5::DOUBLE ELSE sw END, 0.4::DOUBLE) AS t, abs(ix1 - ix0) AS dx, abs(iy1 - iy0) AS dy FROM i JOIN dd USING (p_brand, drawing_seq)),
      b AS (SELECT *, CASE WHEN op = 're' THEN 'r' WHEN op = 'l' AND dy <= 0.75 AND dx >= 0.5 THEN 'h' WHEN op = 'l' AND dx <= 0.75 AND dy >= 0.5 THEN 'v' END AS o FROM j),
      g AS (SELECT p_brand, drawing_seq, item_seq, CASE o WHEN 'v' THEN least(ix0, ix1) - t / 2 WHEN 'h' THEN least(ix0, ix1) ELSE ix0 END AS x, CASE o WHEN 'h' THEN least(iy0, iy1) - t / 2 WHEN 'v' THEN least(iy0, iy1) ELSE iy0 END AS y,
        CASE o WHEN 'v' THEN greatest(dx, t) WHEN 'h' THEN dx ELSE ix1 - ix0 END AS w, CASE o WHEN 'h' THEN greatest(dy, t) WHEN 'v' THEN dy ELSE iy1 - iy0 END AS h, CASE WHEN op = 'l' THEN coalesce(stroke, '#000000') ELSE stroke END AS stroke, CASE WHEN op = 're' THEN fill END AS fill,
        CASE WHEN op = 'l' AND coalesce(sw, 0) = 0 THEN t ELSE sw END AS stroke_width FROM b WHERE o IS NOT NULL),
      kept AS (SELECT * FROM g WHERE {_KEEP}), odd AS (SELECT DISTINCT p_brand, drawing_seq FROM b WHERE op = 'c' OR op = 'l' AND o IS NULL),
      rest AS (SELECT dd.*, x1 - x0 AS w, y1 - y0 AS h, (p_brand, drawing_seq) IN (SELECT (p_brand, drawing_seq) FROM odd) AS raster FROM dd ANTI JOIN kept USING (p_brand, drawing_seq))
      SELECT p_brand, drawing_seq, item_seq, x, y, w AS width, h AS height, stroke, fill, stroke_width, false AS raster FROM kept
      UNION ALL SELECT p_brand, drawing_seq, NULL, x0, y0, w, h, stroke, fill, sw, raster FROM rest WHERE raster OR {_KEEP}""",
    "drawn_boxes": f"WITH {_D}, b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM dd) SELECT p_brand, drawing_seq, x0 AS x, y0 AS y, w AS width, h AS height, stroke, fill FROM b WHERE w >= 5 AND h >= 0.3::DOUBLE OR h >= 5 AND w >= 0.3::DOUBLE OR w > 1 AND h > 1",
    "text_on_fills": f"WITH {_D}, b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM dd WHERE fill IS NOT NULL), f AS (SELECT * FROM b WHERE w >= 5 AND h >= 0.3::DOUBLE OR h >= 5 AND w >= 0.3::DOUBLE OR w > 1 AND h > 1), n AS (SELECT p_brand, p_partkey, p_name AS text, p_partkey % 51 * 10.0::DOUBLE + 2 AS cx, p_partkey % 71 * 8.0::DOUBLE + 1 AS cy FROM part) SELECT n.p_brand, p_partkey, text FROM n SEMI JOIN f ON n.p_brand = f.p_brand AND cx BETWEEN x0 AND x0 + w AND cy BETWEEN y0 AND y0 + h",
    "line_origins": f"""WITH {_LINES}, n AS (SELECT doc_id, line_seq, text, trim(text) AS t, y + line_seq % 3 * 0.03::DOUBLE AS y, round(y + line_seq % 3 * 0.03::DOUBLE, 1) AS r FROM ln),
      o AS (SELECT doc_id, t, r, arg_max(y, line_seq) + 10 AS origin FROM n WHERE line_seq % 4 <> 3 GROUP BY 1, 2, 3) SELECT n.doc_id, line_seq, round(origin, 4) AS origin_y FROM n LEFT JOIN o USING (doc_id, t, r)""",
    "line_metrics": """WITH p AS (SELECT p_partkey, p_partkey % 90 * 7.0::DOUBLE AS y0, CAST(p_size AS DOUBLE) AS s, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 * 50.0::DOUBLE - 50 END AS o, CASE WHEN p_partkey % 5 > 1 THEN (p_partkey % 5 - 1) * 0.3::DOUBLE ELSE 0.8::DOUBLE END AS up,
      CASE WHEN p_partkey % 7 > 1 THEN (p_partkey % 7 - 1) * -0.1::DOUBLE ELSE -0.2::DOUBLE END AS down FROM part), b AS (SELECT *, CASE WHEN coalesce(o, 0) = 0 THEN y0 + s * 0.8::DOUBLE ELSE o END AS base FROM p)
      SELECT p_partkey, round(base, 4) AS baseline, round(CASE WHEN o IS NOT NULL THEN base - s * up ELSE y0 END, 4) AS top, round(greatest(s * (up - down), 11.0::DOUBLE, s), 4) AS height FROM b""",
    "image_overlaps": f"WITH {_R}, t AS (SELECT p_brand, x0, y0, x1, y1 FROM r WHERE k % 10 = 0 UNION ALL SELECT p_brand, x0 - 2, y0 - 2, x0 + 200, y0 + 2 FROM r WHERE k % 9 = 0), i AS (SELECT * FROM r WHERE k % 10 <> 0 AND k % 9 <> 0 AND x1 - x0 >= 1 AND y1 - y0 >= 1) SELECT p_brand, k AS image_seq, EXISTS (SELECT 1 FROM t WHERE t.p_brand = i.p_brand AND i.x0 < t.x1 AND t.x0 < i.x1 AND i.y0 < t.y1 AND t.y0 < i.y1) AS behind FROM i",
    "cell_edges": f"WITH {_R}, e AS (SELECT DISTINCT p_brand, round(unnest([x0, x1]), 1) AS v FROM r), s AS (SELECT p_brand, v - lag(v) OVER (PARTITION BY p_brand ORDER BY v) AS step FROM e) SELECT p_brand, count(*) AS n, round(max(step), 4) AS widest FROM s GROUP BY 1",
    "table_starts": f"WITH {_LINES}, t AS (SELECT doc_id, line_seq // 7 AS table_seq, line_seq FROM ln WHERE line_seq % 7 = 0) SELECT t.doc_id, CAST(table_seq AS BIGINT) AS table_seq, greatest(72.0::DOUBLE, coalesce(max(y + height) + 10, 72.0::DOUBLE)) AS y FROM t LEFT JOIN ln ON ln.doc_id = t.doc_id AND ln.line_seq < t.line_seq GROUP BY t.doc_id, table_seq",
    "stamp_pages": f"WITH {_PAGES} SELECT doc_id, page_index FROM p WHERE doc_id % 3 = 0 OR page_index IN (0, 2)",
    "image_pages": "SELECT p_brand, p_partkey AS file_seq, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS page_index, p_size * 10 AS width, p_size * 7 AS height FROM part WHERE p_partkey % 3 < 2",
    "contents_preview": f"WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_seq) AS n FROM ln) SELECT doc_id, string_agg(text, ' | ' ORDER BY line_seq) AS preview FROM n WHERE n <= 12 GROUP BY 1",
    "newest_file": "SELECT o_custkey, 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "page_points": "SELECT p_partkey, CAST(floor(CAST(p_partkey % 400 AS DOUBLE) / 400 * 595 + 40.5::DOUBLE) AS BIGINT) AS x, CAST(floor(CAST(p_partkey % 300 AS DOUBLE) / 300 * 842 + 20.5::DOUBLE) AS BIGINT) AS y FROM part",
    "watermark_tiles": "SELECT doc_id, count(*) AS n, sum(a.i * 150.0::DOUBLE) AS sum_x, sum(u.i * 120.5::DOUBLE) AS sum_y FROM documents, range(4) a(i), range(7) u(i) GROUP BY 1",
    "line_duplicates": f"""WITH {_LINES}, c AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS t, x, y + CASE WHEN line_seq % 2 = 0 THEN 0 ELSE 40 END AS y, width, height FROM ln WHERE line_seq % 3 = 0),
      k AS (SELECT * FROM (SELECT *, regexp_replace(text, '\\s', '', 'g') AS t FROM ln) n ANTI JOIN c ON n.doc_id = c.doc_id AND n.t = c.t AND n.x + n.width / 2 BETWEEN c.x - n.height / 2 AND c.x + c.width + n.height / 2 AND n.y + n.height / 2 BETWEEN c.y - n.height / 2 AND c.y + c.height + n.height / 2) SELECT doc_id, count(*) AS n, min(line_seq) AS first FROM k GROUP BY 1""",
    "kept_fills": "SELECT p_partkey FROM part WHERE p_partkey % 4 = 2 AND p_partkey % 11 <> 0 AND p_size / 10.0 >= 2 AND p_size / 5.0 >= 2",
    "visible_cells": """WITH RECURSIVE c AS (SELECT s_suppkey, CAST(r AS INT) AS row, CAST(q AS INT) AS col, CASE WHEN q = 3 AND r % 2 = s_suppkey % 2 THEN 2 ELSE 1 END AS rs, CASE WHEN (r + s_suppkey) % 4 = 0 AND q = 0 THEN 3 ELSE 1 END AS cs FROM supplier, range(4) a(r), range(4) b(q)),
      v AS (SELECT s_suppkey, -1 AS n, CAST([] AS STRUCT(row INT, col INT, rs INT, cs INT)[]) AS held FROM supplier UNION ALL
        SELECT v.s_suppkey, v.n + 1, CASE WHEN len(list_filter(held, lambda k: c.row >= k.row AND c.row < k.row + k.rs AND c.col >= k.col AND c.col < k.col + k.cs)) > 0 THEN held ELSE list_append(held, {'row': c.row, 'col': c.col, 'rs': c.rs, 'cs': c.cs}) END
        FROM v JOIN c ON c.s_suppkey = v.s_suppkey AND c.row * 4 + c.col = v.n + 1)
      SELECT s_suppkey, k.row AS row, k.col AS col FROM (SELECT s_suppkey, unnest(held) AS k FROM v WHERE n = 15)""",
    "result_names": "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '.') || ['.pdf', '.PDF', '.pdf.pdf', 'pdf'][p_partkey % 4 + 1], '(?i)\\.pdf$', '.docx') AS name FROM part",
    "merged_rows": "SELECT p_partkey, p_partkey % 3 = 1 AS merged FROM part",
    "media_places": """WITH b AS (SELECT p_brand, p_partkey AS seq, 'm' || (p_partkey % 9) AS id FROM part WHERE p_partkey % 4 <> 0), m AS (SELECT p_brand, 'm' || (p_partkey % 9) AS id, arg_min(p_size, p_partkey) AS natural_w, CAST(arg_min(p_partkey % 100, p_partkey) AS INT) AS natural_h FROM part WHERE p_partkey % 9 < 7 GROUP BY 1, 2)
      SELECT b.p_brand, seq, b.id, natural_w, natural_h FROM b LEFT JOIN m ON b.p_brand = m.p_brand AND b.id = m.id""",
    "range_syntax": "SELECT p_partkey, p_partkey % 7 IN (0, 2, 6) AS valid FROM part",
    "product_grants": "SELECT user_id, CASE WHEN event_id % 10 = 1 THEN 'monthly' WHEN event_id % 10 IN (2, 3) THEN 'one_time' END AS grants, count(*) AS n FROM events GROUP BY 1, 2",
    "settings": f"""WITH e AS (SELECT event_id, event_id % 8 AS k, event_type, md5(CAST(event_id AS VARCHAR)) AS m FROM events), v AS (SELECT event_id, CASE k WHEN 0 THEN {_UUID} WHEN 1 THEN '  ' || upper({_UUID}) WHEN 2 THEN {_UUID} || '0' WHEN 3 THEN '00000000-0000-0000-0000-000000000000' WHEN 4 THEN 'sk-XXxxXX' WHEN 5 THEN 'your-' || event_type WHEN 6 THEN ' ' ELSE event_type END AS v FROM e)
      SELECT event_id, regexp_full_match(trim(v), '(?i)[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AS uuid, trim(v) IN ('', 'click', '00000000-0000-0000-0000-000000000000') OR regexp_matches(v, '(?i)x{{6}}') OR contains(v, 'your-') OR contains(v, 'replace-with-') AS placeholder FROM v""",
    "email_shapes": "SELECT c_custkey, c_custkey % 4 = 0 AS valid FROM customer",
}
