"""Documents as structured pages: headings and the first table, as nested rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators import documents as D
from leafmill.sources.tables import table


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one page: its lines of fields are a table, some of whose cells span others or are missing."""
    d = F.col("doc_id")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_seq", "text")).withColumns({"x": F.lit(0.0), "y": F.col("line_seq") * 14.0})
    fields = lines.where(F.col("text").contains("|")).withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("line_seq")) - 1)
    cells = fields.select("doc_id", "row", F.posexplode(F.split("text", r"\|")).alias("col", "text"))
    wide = cells.groupBy("doc_id").agg((F.max("col") + 1).alias("n"))
    tables = fields.groupBy("doc_id").agg(F.min("y").alias("y"), F.count("*").cast("int").alias("m")).join(wide, "doc_id")
    tables = tables.select("doc_id", F.lit(0).alias("table_seq"), "y", (F.col("n") * 40.0).alias("width"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i * 7 + d % 3).cast("double") / 4).alias("columns"), F.array_repeat(F.lit(14.0), F.col("m")).alias("row_heights"))
    spans = {"col_span": F.when((F.col("row") + F.col("col") + d) % 4 == 0, 2).otherwise(1), "row_span": F.when((F.col("row") * 3 + F.col("col") + d) % 5 == 0, 2).otherwise(0), "cell_seq": F.lit(0), "table_seq": F.lit(0)}
    out = D.structured_pages(lines, tables, cells.where((F.col("row") + F.col("col")) % 7 != 3).withColumns(spans), ["doc_id"])
    cell = lambda c: F.concat_ws(",", c["col"], c["col_span"], c["row_span"], c["width"], c["height"], c["text"])
    shown = F.array_join(F.transform("rows", lambda r: F.concat(r["height"].cast("string"), F.lit(":"), F.array_join(F.transform(r["cells"], cell), ";"))), "\n")
    return out.select("doc_id", "title", "slogan", "margin_top", "width", F.size("rows").alias("n_rows"), F.md5(shown.cast("binary")).alias("md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"structured_documents": structured_documents}
#: The table's places one after the other, with those that are taken so far.
SQL = {
    "structured_documents": r"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
f AS (SELECT doc_id, i, string_split(s, '|') AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r FROM l WHERE contains(s, '|')),
t AS (SELECT doc_id, min(i) * 14.0::DOUBLE AS y, count(*) AS m, max(len(c)) AS n FROM f GROUP BY doc_id),
h AS (SELECT l.doc_id, floor(l.i * 14 / 3.0 + 0.5) AS b, min(l.i) AS seq, trim(string_agg(s, '' ORDER BY l.i), ' ' || chr(9) || chr(13)) AS s FROM l LEFT JOIN t ON t.doc_id = l.doc_id WHERE t.y IS NULL OR l.i * 14 < t.y GROUP BY 1, 2 HAVING trim(string_agg(s, '' ORDER BY l.i), ' ' || chr(9) || chr(13)) <> ''),
k AS (SELECT doc_id, s AS title FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(s) DESC, seq) = 1),
o AS (SELECT h.doc_id, h.s AS slogan FROM h JOIN k ON k.doc_id = h.doc_id AND h.s <> k.title QUALIFY row_number() OVER (PARTITION BY h.doc_id ORDER BY seq) = 1),
g AS (SELECT t.doc_id, t.n, t.m, p.q, p.q // t.n AS r, p.q % t.n AS c FROM t, LATERAL (SELECT unnest(range(t.n * t.m)) AS q) p),
e AS (
  SELECT g.doc_id, g.q + 1 AS q, g.r, g.c, n, m, CASE WHEN (g.r + g.c) % 7 = 3 OR g.c >= len(f.c) THEN '' ELSE f.c[g.c + 1] END AS s,
    CASE WHEN (g.r + g.c) % 7 <> 3 AND g.c < len(f.c) AND (g.r + g.c + g.doc_id) % 4 = 0 THEN 2 ELSE 1 END AS cs, CASE WHEN (g.r + g.c) % 7 <> 3 AND g.c < len(f.c) AND (g.r * 3 + g.c + g.doc_id) % 5 = 0 THEN 2 ELSE 1 END AS rs
  FROM g JOIN f ON f.doc_id = g.doc_id AND f.r = g.r
),
z AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS q, CAST([] AS BIGINT[]) AS taken, false AS shown FROM t
  UNION ALL
  SELECT e.doc_id, e.q, CASE WHEN list_contains(taken, r * 1000 + c) THEN taken ELSE list_concat(list_filter(taken, lambda x: x >= r * 1000), [r * 1000 + c], CASE WHEN cs = 2 THEN [r * 1000 + c + 1] ELSE [] END,
    CASE WHEN rs = 2 THEN [r * 1000 + 1000 + c] ELSE [] END, CASE WHEN rs = 2 AND cs = 2 THEN [r * 1000 + 1001 + c] ELSE [] END) END, NOT list_contains(taken, r * 1000 + c)
  FROM z JOIN e ON e.doc_id = z.doc_id AND e.q = z.q + 1
),
v AS (
  SELECT e.doc_id, e.r, string_agg(e.c || ',' || cs || ',' || rs || ',' || greatest(300, CAST(floor(list_sum(list_transform(range(e.c + 1, least(e.c + cs, n) + 1), lambda i: CAST(i * 7 + e.doc_id % 3 AS DOUBLE) / 4)) * 100 + 0.5) AS INT)) || ',' ||
    greatest(300, 1400 * least(rs, m - e.r)) || ',' || s, ';' ORDER BY e.c) FILTER (shown) AS cells
  FROM e JOIN z ON z.doc_id = e.doc_id AND z.q = e.q GROUP BY 1, 2
),
w AS (SELECT doc_id, count(*) AS n_rows, string_agg('1400:' || coalesce(cells, ''), chr(10) ORDER BY r) AS s FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(title, 'PDF 문서') AS title, slogan, CAST(greatest(0, 9600 + coalesce(floor((y - 124.55::DOUBLE) * 100 + 0.5), 0)) AS INT) AS margin_top, CAST(n * 4000 AS INT) AS width, CAST(n_rows AS INT) AS n_rows, md5(s) AS md5
FROM (SELECT DISTINCT doc_id FROM l) d LEFT JOIN k USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN w USING (doc_id)
""",
}
