"""Queries on structured documents; documents' lines and words stand in for positioned content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import corner
from leafmill.operators import documents as D
from leafmill.plans.layout import _LINES, _PAGES, doc_pages, text_lines
from leafmill.sources.tables import table


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a page of two turns, their texts as items."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("page"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    return D.page_text(c, "conv_id", "page", "turn", "text", "\n\n").select("conv_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").cast("long").alias("chars"))


def doc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.headings(text_lines(spark, sf_dir, dealt=True), ["doc_id"])
    return out.select("doc_id", "title", "slogan")


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.gaps(text_lines(spark, sf_dir).withColumn("y", F.col("y") * 4), ["doc_id"], ["y", "line_seq"])
    return out.groupBy("doc_id").agg(F.sum("gap").alias("gap"), F.max("gap").alias("largest"))


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of text are the spans of one."""
    n = text_lines(spark, sf_dir)
    s = n.select("doc_id", F.expr("line_seq div 3").alias("line"), F.col("line_seq").alias("seq"), "text", (F.col("line_seq") % 4).cast("string").alias("font"), (F.col("line_seq") % 5 + 8.0).alias("size"), (F.col("line_seq") % 2 == 0).alias("bold"))
    return D.merged_spans(s, ["doc_id", "line"])


def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a table at the height of every fifth."""
    n = text_lines(spark, sf_dir)
    t = n.where("line_seq % 5 = 0").select("doc_id", F.col("line_seq").alias("table_seq"), "y")
    return D.interleaved(n, t, ["doc_id"]).select("doc_id", "kind", "seq", "place")


def push_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each document against two tables."""
    n = text_lines(spark, sf_dir).select("doc_id", "line_seq", "y", "height")
    t = n.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("table_seq")).withColumn("y", F.col("table_seq") * 60.0 + 5).withColumn("height", F.lit(20.0))
    return D.pushed_down(n, t, ["doc_id"]).select("doc_id", "line_seq", "y")


def export_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter spacing, top, nearest column edge and alignment of every line."""
    n = text_lines(spark, sf_dir)
    edges = F.array(*(F.lit(float(e)) for e in (0, 40, 80, 200)))
    natural = F.length("text") * (F.col("line_seq") % 7 + 3.0)
    return n.select(
        "doc_id", "line_seq", D.letter_spacing(F.col("width"), natural, F.col("text")).alias("spacing"), D.box_top(F.when(F.col("line_seq") % 2 == 0, F.col("y") + 9), F.col("y"), F.lit(1200.0), F.lit(75.0)).alias("top"),
        D.nearest_edge(edges, F.col("x") + F.col("line_seq") % 30).alias("edge"), D.line_align(F.col("x"), F.lit(0.0), F.lit(90.0), F.col("line_seq") % 10 == 0).alias("align"),
    )


def rules_under_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes as thin rules, a table at the top of each document."""
    b = text_lines(spark, sf_dir).select("doc_id", "line_seq", "x", "y", "width", F.lit(2.0).alias("height"))
    t = b.select("doc_id").distinct().select("doc_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(500.0).alias("width"), F.lit(20.0).alias("height"))
    return D.without_table_rules(b, t, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_seq").alias("first"))


def placed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document around two tables; every third document has none."""
    n = text_lines(spark, sf_dir).select("doc_id", "line_seq", "y", (F.col("line_seq") % 3 + 1.0).alias("size"))
    t = n.where("doc_id % 3 > 0").select("doc_id").distinct().withColumn("table_seq", F.explode(F.sequence(F.lit(0), F.lit(1))))
    t = t.select("doc_id", "table_seq", (F.col("table_seq") * 50 + 21.0).alias("y"), (F.col("table_seq") * 50 + 44.0).alias("bottom"))
    return D.placed_gaps(n, t, ["doc_id"], 10.0)


def absent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line against the lines before the tenth."""
    n = text_lines(spark, sf_dir)
    out = D.absent_texts(n.where("line_seq % 2 = 0").withColumn("text", F.concat(F.lit(" "), "text")), n.where("line_seq < 10"), ["doc_id"])
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_seq").alias("first"))


def zipped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents with pictures of the first two of them."""
    p = doc_pages(spark, sf_dir)
    images = p.where("page_index < 2 and doc_id % 2 = 0").select("doc_id", "page_index", F.concat(F.lit("p"), F.col("page_index").cast("string"), F.lit(".png")).alias("image"))
    return D.zipped_pages(p.select("doc_id", "page_index", "n_lines"), images)


def stamp_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp of each part's size at every named place of a page."""
    s = F.col("p_size").cast("double")
    place = F.explode(F.array(*map(F.lit, ("top-left", "top-right", "bottom-left", "bottom-right", "centre"))))
    p = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), place.alias("place"))
    x, y = corner(F.col("place"), F.lit(595.0), F.lit(842.0), F.col("s"), F.col("s") / 2)
    return p.select("p_partkey", "place", x.alias("x"), y.alias("y"))


QUERIES = {f.__name__: f for f in (page_text, doc_headings, line_gaps, span_merge, interleave, push_down, export_geometry, rules_under_tables, placed_gaps, absent_texts, zipped_pages, stamp_corners)}
SQL = {
    "page_text": "WITH p AS (SELECT conv_id, turn // 2 AS page, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t FROM conversations GROUP BY 1, 2), d AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS t FROM p GROUP BY 1) SELECT conv_id, md5(t) AS md5, len(t) AS chars FROM d",
    "doc_headings": f"""WITH {_LINES}, r AS (SELECT doc_id, floor(y / 3 + 0.5) AS b, min(line_seq) AS seq, trim(string_agg(text, '' ORDER BY x, line_seq)) AS t FROM ln GROUP BY 1, 2),
      t AS (SELECT doc_id, t AS title FROM r WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(t) DESC, seq) = 1),
      s AS (SELECT r.doc_id, t AS slogan FROM r JOIN t ON r.doc_id = t.doc_id WHERE t <> '' AND t <> title QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY seq) = 1) SELECT doc_id, title, slogan FROM t LEFT JOIN s USING (doc_id)""",
    "line_gaps": f"WITH {_LINES}, g AS (SELECT doc_id, greatest(0, y * 4 - coalesce(lag(y * 4 + height) OVER (PARTITION BY doc_id ORDER BY y, line_seq), 0)) AS gap FROM ln) SELECT doc_id, sum(gap) AS gap, max(gap) AS largest FROM g GROUP BY 1",
    "span_merge": f"WITH {_LINES}, s AS (SELECT doc_id, line_seq // 3 AS line, line_seq, text FROM ln), a AS (SELECT doc_id, line, trim(string_agg(text, '' ORDER BY line_seq)) AS t, arg_max(line_seq, len(text) * 100000 - line_seq) AS k FROM s GROUP BY 1, 2) SELECT doc_id, CAST(line AS BIGINT) AS line, t AS text, CAST(k % 4 AS VARCHAR) AS font, k % 5 + 8.0::DOUBLE AS size, k % 2 = 0 AS bold FROM a WHERE t <> ''",
    "interleave": f"WITH {_LINES}, b AS (SELECT doc_id, 1 AS kind, line_seq AS seq, y FROM ln UNION ALL SELECT doc_id, 0, line_seq, y FROM ln WHERE line_seq % 5 = 0) SELECT doc_id, kind, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, kind, seq) - 1 AS INT) AS place FROM b",
    "push_down": f"""WITH RECURSIVE {_LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_seq) AS n FROM ln),
      a AS (SELECT doc_id, n, line_seq, height, CASE WHEN y < 25 AND y + height > 5 THEN 35 ELSE y END AS y1 FROM o), b AS (SELECT doc_id, n, line_seq, height, CASE WHEN y1 < 85 AND y1 + height > 65 THEN 95 ELSE y1 END AS y2 FROM a),
      f AS (SELECT doc_id, n, line_seq, greatest(y2, 0)::DOUBLE AS y, height FROM b WHERE n = 1 UNION ALL SELECT b.doc_id, b.n, b.line_seq, greatest(b.y2, f.y + f.height + 4)::DOUBLE, b.height FROM f JOIN b ON b.doc_id = f.doc_id AND b.n = f.n + 1) SELECT doc_id, line_seq, y FROM f""",
    "export_geometry": f"""WITH {_LINES}, v AS (SELECT *, len(text) * (line_seq % 7 + 3.0::DOUBLE) AS nat, x + line_seq % 30 AS v FROM ln) SELECT doc_id, line_seq, CAST(CASE WHEN nat > 0.5 AND width > 0.5 AND len(text) > 1 THEN greatest(-50, least(50, round((width / nat - 1) * 100))) ELSE 0 END AS INT) AS spacing,
      CAST(round(greatest(0, CASE WHEN line_seq % 2 = 0 THEN y + 9 - 0.85::DOUBLE * (1200.0::DOUBLE / 75) ELSE y END) * 75) AS BIGINT) AS top,
      CASE WHEN v <= 20 THEN 0 WHEN v <= 60 THEN 1 WHEN v <= 140 THEN 2 ELSE 3 END AS edge, CASE WHEN line_seq % 10 = 0 THEN 'center' WHEN x / 90 > 0.3 AND x / 90 < 0.7 THEN 'center' WHEN x / 90 > 0.8 THEN 'right' ELSE 'left' END AS align FROM v""",
    "rules_under_tables": f"WITH {_LINES} SELECT doc_id, count(*) AS n, min(line_seq) AS first FROM ln WHERE NOT (width >= 475 AND x <= 2 AND y > 20 AND y - 20 < 25) GROUP BY 1",
    "placed_gaps": f"""WITH {_LINES}, n AS (SELECT doc_id, 'text' AS kind, line_seq AS seq, CASE WHEN doc_id % 3 = 0 OR y < 21 THEN 0 ELSE 2 END AS part, y AS a, y, y + line_seq % 3 + 1 AS e FROM ln),
      t AS (SELECT DISTINCT doc_id, 'table' AS kind, CAST(k AS INT) AS seq, 1 AS part, CAST(k AS DOUBLE) AS a, k * 50 + 21.0::DOUBLE AS y, k * 50 + 44.0::DOUBLE AS e FROM ln, range(2) r(k) WHERE doc_id % 3 > 0), u AS (SELECT * FROM n UNION ALL SELECT * FROM t)
      SELECT doc_id, kind, seq, CAST(row_number() OVER w - 1 AS INT) AS place, greatest(0.0::DOUBLE, y - coalesce(lag(e) OVER w, 10)) AS gap FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY part, a, seq)""",
    "absent_texts": f"WITH {_LINES} SELECT doc_id, count(*) AS n, min(line_seq) AS first FROM ln WHERE line_seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ln o WHERE o.doc_id = ln.doc_id AND o.line_seq < 10 AND trim(o.text) = trim(ln.text)) GROUP BY 1",
    "zipped_pages": f"WITH {_PAGES} SELECT doc_id, page_index, n_lines, CASE WHEN page_index < 2 AND doc_id % 2 = 0 THEN 'p' || page_index || '.png' END AS image FROM p",
    "stamp_corners": "SELECT p_partkey, place, CASE WHEN place LIKE '%left' THEN 50.0::DOUBLE WHEN place LIKE '%right' THEN 545 - p_size ELSE (595 - p_size) / 2.0::DOUBLE END AS x, CASE WHEN place LIKE 'top%' THEN 792 - p_size / 2.0::DOUBLE WHEN place LIKE 'bottom%' THEN 50.0::DOUBLE ELSE (842 - p_size / 2.0::DOUBLE) / 2 END AS y FROM part, (VALUES ('top-left'), ('top-right'), ('bottom-left'), ('bottom-right'), ('centre')) v(place)",
}
