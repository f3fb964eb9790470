"""Documents as Markdown and its HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import markdown as D
from leafmill.sources.tables import table

#: What stands before a line of a document to make Markdown of it, by its place, and what behind it.
_MARKS = (
    ("", ""), ("# ", ""), ("- ", ""), ("* **b** ", ""), ("1. ", ""), ("> ", ""), ("```sql ", ""), ("| a | ", " |"),
    ("  - ", " "), ("2.", ""), ("| ", " | `c` |"), ("#### ", " __x__"), ("12.  ", ""), ("&\"<", "\t"),
)
_WHOLE = ("---", "|---|:-:|", "", "***", "```")


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown, its lines made headings, items, rows, quotes, code and rules by their place."""
    n = F.col("doc_id") * 7 + F.col("i") * (F.col("doc_id") % 5 + 1)
    marks = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _MARKS))
    whole = F.get(F.array(*map(F.lit, _WHOLE)), (n % len(_WHOLE)).cast("int"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("m", F.get(marks, (n % len(_MARKS)).cast("int")))
    line = F.when(n % 6 == 5, whole).otherwise(F.concat("m.a", "t", "m.b"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("s")))).alias("l"))
    out = D.markdown_html(docs.select("doc_id", F.array_join(F.transform("l", lambda x: x.s), "\n").alias("md")), ["doc_id"], "md")
    return out.select("doc_id", F.length("html").cast("long").alias("n"), F.md5(F.col("html").cast("binary")).alias("md5"))


def _inline(x: str) -> str:
    for pattern, out in X.INLINE:
        x = f"regexp_replace({x}, '{pattern}', '{out.replace('$', chr(92))}', 'g')"
    return x


def _sql() -> str:
    """A fold over the lines of all documents at once, one line a step."""
    text = lambda s: "'" + s.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"
    marks = "[" + ", ".join(f"[{text(a)}, {text(b)}]" for a, b in _MARKS) + "]"
    whole = "[" + ", ".join(map(text, _WHOLE)) + "]"
    ws = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    strip = lambda x: f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"
    code = "raw"
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        code = f"replace({code}, {text(plain)}, {text(escaped)})"
    item = f"CASE k WHEN 'ul' THEN substr(s, 3) ELSE regexp_extract(s, '^\\d+\\.{ws}+(.+)$', 1) END"
    row = f"'<tr>' || array_to_string(list_transform(cells, lambda c: '<td>' || {_inline(strip('c'))} || '</td>'), '') || '</tr>'"
    heading = _inline(f"regexp_extract(s, '^#+{ws}+(.+)$', 1)")
    return f"""
WITH RECURSIVE a AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b AS (SELECT doc_id, i, t, doc_id * 7 + i * (doc_id % 5 + 1) AS n FROM a),
c AS (SELECT doc_id, i + 1 AS i, CASE WHEN n % 6 = 5 THEN {whole}[n % {len(_WHOLE)} + 1] ELSE {marks}[n % {len(_MARKS)} + 1][1] || t || {marks}[n % {len(_MARKS)} + 1][2] END AS raw FROM b),
d AS (SELECT *, {strip('raw')} AS s FROM c),
e AS (SELECT *, CASE WHEN s LIKE '|%' THEN string_split(s, '|')[2:-2] ELSE [] END AS cells FROM d),
l AS (
  SELECT *, CASE WHEN s LIKE '```%' THEN 'mark' WHEN regexp_matches(s, '^(---+|\\*\\*\\*+|___+)$') THEN 'rule' WHEN regexp_matches(s, '^#{{1,6}}{ws}+.+$') THEN 'heading'
    WHEN s LIKE '|%' THEN CASE WHEN len(list_filter(cells, lambda c: NOT regexp_matches({strip('c')}, '^[-:]+$'))) = 0 THEN 'divider' ELSE 'row' END
    WHEN regexp_matches(s, '^[-*+] ') THEN 'ul' WHEN regexp_matches(s, '^\\d+\\.{ws}+.+$') THEN 'ol' WHEN s LIKE '> %' THEN 'quote' WHEN s = '' THEN 'blank' ELSE 'p' END AS k FROM e
),
h AS (
  SELECT *, CASE k WHEN 'rule' THEN '<hr>' WHEN 'heading' THEN '<h' || len(regexp_extract(s, '^#+')) || '>' || {heading} || '</h' || len(regexp_extract(s, '^#+')) || '>'
    WHEN 'row' THEN {row} WHEN 'ul' THEN '<li>' || {_inline(item)} || '</li>' WHEN 'ol' THEN '<li>' || {_inline(item)} || '</li>' WHEN 'quote' THEN '<blockquote>' || {_inline('substr(s, 3)')} || '</blockquote>'
    WHEN 'blank' THEN '' WHEN 'p' THEN '<p>' || {_inline('s')} || '</p>' END AS html,
    CASE WHEN s = '```' THEN '<pre><code>' ELSE '<pre><code class="language-' || {strip('substr(s, 4)')} || '">' END AS opened, {code} AS code, NOT (k IN ('ul', 'ol') OR regexp_matches(s, '^\\d+\\.')) AS ends FROM l
),
f AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, false AS fence, '' AS list, '' AS rows, CAST([] AS VARCHAR[]) AS out FROM h
  UNION ALL
  SELECT f.doc_id, h.i, CASE WHEN k = 'mark' THEN NOT fence ELSE fence END,
    CASE WHEN fence OR k = 'mark' THEN list WHEN k IN ('ul', 'ol') THEN k WHEN ends THEN '' ELSE list END,
    CASE WHEN fence OR k IN ('mark', 'rule', 'heading', 'divider') THEN rows WHEN k = 'row' THEN rows || html ELSE '' END,
    CASE WHEN k = 'mark' THEN list_append(out, CASE WHEN fence THEN '</code></pre>' ELSE opened END) WHEN fence THEN list_append(out, code)
      ELSE list_concat(out, CASE WHEN ends AND list <> '' THEN ['</' || list || '>'] ELSE [] END, CASE WHEN rows <> '' AND k NOT IN ('rule', 'heading', 'divider', 'row') THEN ['<table>' || rows || '</table>'] ELSE [] END,
        CASE WHEN k IN ('ul', 'ol') AND list <> k THEN list_concat(CASE WHEN list <> '' THEN ['</' || list || '>'] ELSE [] END, ['<' || k || '>']) ELSE [] END, CASE WHEN k IN ('divider', 'row') THEN [] ELSE [html] END) END
  FROM f JOIN h ON h.doc_id = f.doc_id AND h.i = f.i + 1
),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
y AS (SELECT doc_id, array_to_string(list_concat(out, CASE WHEN fence THEN ['</code></pre>'] ELSE [] END, CASE WHEN list <> '' THEN ['</' || list || '>'] ELSE [] END, CASE WHEN rows <> '' THEN ['<table>' || rows || '</table>'] ELSE [] END), chr(10)) AS html FROM z)
SELECT doc_id, len(html) AS n, md5(html) AS md5 FROM y
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"markdown_documents": markdown_documents}
SQL = {"markdown_documents": _sql()}
