"""Queries on personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import masking as M
from leafmill.operators import personal_data as P
from leafmill.sources import layout_files
from leafmill.sources.scratch import scratch_path
from leafmill.sources.tables import table


def pii_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect_preview(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by kind; kinds without any count 0."""
    kinds = spark.createDataFrame([(k,) for k in P.KINDS], "type string")
    found = pii_preview(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return kinds.join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def pii_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return P.detect_preview(docs, ["doc_id", "lang"]).groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect_preview(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])


def pii_email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect_preview(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], kinds=("email",)).select("doc_id", "text", "masked_text")


def pii_card_luhn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect_preview(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], kinds=("card",)).select("doc_id", "text", "masked_text", "verified")


def pii_phone_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phone match in the text without white space, and whether its surroundings make it a business number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", M.no_space(F.col("text")).alias("t"))
    hits = docs.select("doc_id", "t", F.explode(M.located(F.col("t"), M.PATTERNS["phone"])).alias("m"))
    return hits.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.text").alias("text"), M.business_number(F.col("t"), F.col("m.start"), F.length("m.text")).alias("suppressed"))


#: Some of the labels that make a number a registration number, and what doesn't.
_LABELS = ["등록번호 ", "발급 번 호:", "발급번호", "전화 ", "구직등록번호  ", "tel ", "x", "등록 번호", ""]


def pii_fixture_rrn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key as a number of thirteen digits, with and without its dash; some are cut short."""
    k = F.col("c_custkey")
    d = F.lpad((k % 1000000 * 7919104729 % 10000000000000).cast("string"), 13, "0")
    s = F.when(k % 5 == 0, F.substring(d, 1, 7)).when(k % 2 == 0, F.concat(F.substring(d, 1, 6), F.lit("-"), F.substr(d, F.lit(7)))).otherwise(d)
    c, s = table(spark, sf_dir, "customer").select("c_custkey", s.alias("s")), F.col("s")
    return c.select("c_custkey", "s", M.mask_rrn(s).alias("masked"), M.format_rrn(s).alias("formatted"), F.coalesce(M.valid_rrn(s), F.lit(False)).alias("valid"))


def pii_fixture_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key as an account number, as a date, or as digits of any number."""
    k = F.col("c_custkey")
    n = F.lpad((k * 104729 % 1000000).cast("string"), 6, "0")
    s = F.when(k % 4 == 0, F.concat(F.lit("110-234-"), n)).when(k % 4 == 1, F.concat((k % 300 + 1850).cast("string"), F.lit("-"), (k % 14).cast("string"), F.lit("-"), n)).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(n, n))
    c, s = table(spark, sf_dir, "customer").select("c_custkey", s.alias("s")), F.col("s")
    return c.select("c_custkey", "s", M.mask_account(s).alias("masked"), F.length(M.digits_of(s)).cast("long").alias("n_digits"), F.coalesce(M.date_shaped(s), F.lit(False)).alias("date_shaped"))


def pii_fixture_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name as a local part of one letter, two or more; some addresses lack their host or their sign."""
    k = F.col("c_custkey")
    local = F.substr("c_name", F.lit(1), (k % 5).cast("int"))
    s = F.when(k % 7 == 0, F.col("c_name")).when(k % 7 == 1, F.concat(local, F.lit("@"))).when(k % 7 == 2, F.concat(local, F.lit("@y@"), "c_mktsegment")).otherwise(F.concat(local, F.lit("@"), "c_mktsegment", F.lit(".kr")))
    c = table(spark, sf_dir, "customer").select("c_custkey", s.alias("s"))
    return c.select("c_custkey", "s", M.mask_email(F.col("s")).alias("masked"))


def labelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's phone behind a label, by its key one that names a registration number, one that doesn't, a letter, or nothing."""
    s = table(spark, sf_dir, "supplier")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("s_suppkey") % len(_LABELS) + 1).cast("int"))
    digits = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    text = F.concat(label, F.lit("010-"), F.substring(digits, 1, 4), F.lit("-"), F.substr(digits, F.lit(5)), F.lit(" "), F.col("s_name"))
    return s.select("s_suppkey", text.alias("text"))


def pii_label_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in labelled numbers: registration labels and letters right before a number suppress it."""
    return P.detect_preview(labelled_numbers(spark, sf_dir), ["s_suppkey"])


def conversation_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a contact line of their own behind them, as people sign messages."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = F.lpad(((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 100000000).cast("string"), 8, "0")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\nphone 010 "), F.substring(n, 1, 4), F.lit(" "), F.substr(n, F.lit(5)), F.lit("!")))
    line = line.when(F.col("turn") % 3 == 1, F.concat(F.lit("\nmail u"), n, F.lit("@mail"), F.col("turn").cast("string"), F.lit(".example.org now")))
    line = line.otherwise(F.concat(F.lit("\naccount 110-234-"), n, F.lit(" card "), F.substring(n, 1, 4), F.lit("-4111-1111-1111")))
    return c.select("conv_id", "turn", F.concat("text", line).alias("text"))


def pii_signed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in signed conversation turns."""
    return P.detect_preview(conversation_contacts(spark, sf_dir), ["conv_id", "turn"])


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as positioned text: a line of text is one item, 14 units below the last; 50 lines a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "str"))
    at = F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), F.lit(0.0), (F.col("i") * -14 + 700).cast("double"))
    return docs.select("doc_id", F.expr("i div 50").cast("int").alias("page_index"), F.col("i").alias("item_seq"), "str", at.alias("transform"), (F.length("str") * 6.0).alias("width"), F.lit(12.0).alias("height"))


def pii_positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds in documents laid out as pages, whose items are written to layout files and read back from them."""
    path = scratch_path(spark, "layout")
    layout_files.write_part(text_items(spark, sf_dir), path, "items")
    return P.detect_positioned(layout_files.read_part(spark, path, "items"), ["doc_id", "page_index"], shown=P.KINDS)


_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The patterns once more, as DuckDB spells them.
_PHONE = r"(?:01[016789]-?\d{3,4}-?\d{4})|(?:0[2-6][1-5]?-?\d{3,4}-?\d{4})"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_CARD = rf"\d{{4}}(?:-|{_WS})?\d{{4}}(?:-|{_WS})?\d{{4}}(?:-|{_WS})?\d{{4}}"
_LABEL = r"(?:구직\s*등록\s*번\s*호|구직등록번호|발급\s*번\s*호|발급번호|등록\s*번\s*호|등록번호)$"
_LUHN = """list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, 17 - i, 1) AS INT) * 2
   - CASE WHEN CAST(substr(d, 17 - i, 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(d, 17 - i, 1) AS INT) END)) % 10 = 0"""


def _detections(source: str, keys: str) -> str:
    """CTEs ending in ``kept(keys, type, text, masked_text, verified)``; look-behind is spelled by doubling separators."""
    on = keys.replace(" ", "").split(",")
    part = ", ".join(on)
    return f"""
src AS (SELECT {keys}, text, regexp_replace(text, '{_WS}+', '', 'g') AS n FROM {source}),
rrn AS (SELECT {keys}, replace(unnest(regexp_extract_all(regexp_replace(' ' || n || ' ', '([^A-Za-z0-9])', '\\1\\1', 'g'), '[^A-Za-z0-9](\\d{{6}}(?:--)?\\d{{7}})[^A-Za-z0-9]', 1)), '--', '') AS d FROM src),
ph0 AS (SELECT {keys}, n, regexp_extract_all(n, '{_PHONE}') AS m, string_split_regex(n, '{_PHONE}') AS g FROM src),
ph1 AS (SELECT {keys}, n, m, g, unnest(range(1, len(m) + 1)) AS k FROM ph0 WHERE len(m) > 0),
ph2 AS (SELECT {keys}, n, k, m[k] AS t, CAST(list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: len(x))), 0) AS BIGINT) AS pos FROM ph1),
ph AS (SELECT *, regexp_matches(substr(n, greatest(pos - 29, 1), least(pos, 30)), '[A-Za-z]$|{_LABEL}') OR regexp_matches(substr(n, pos + len(t) + 1, 1), '^[A-Za-z0-9]') AS bad, replace(t, '-', '') AS d FROM ph2),
em AS (SELECT {keys}, unnest(regexp_extract_all(text, '{_EMAIL}')) AS t FROM src),
ac AS (SELECT {keys}, unnest(regexp_extract_all(text, '\\d{{2,6}}-\\d{{2,6}}-\\d{{2,6}}(?:-\\d{{1,3}})?')) AS t FROM src),
cd AS (SELECT {keys}, t, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM (SELECT {keys}, unnest(regexp_extract_all(text, '{_CARD}')) AS t FROM src)),
found AS (
  SELECT {keys}, 5 AS pr, 'rrn' AS type, substr(d, 1, 6) || '-' || substr(d, 7) AS text, substr(d, 1, 6) || '-' || substr(d, 7, 1) || '******' AS masked_text,
    (11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, i, 1) AS INT) * [2,3,4,5,6,7,8,9,2,3,4,5][i])) % 11) % 10 = CAST(substr(d, 13, 1) AS INT) AS verified FROM rrn
  UNION ALL SELECT {keys}, 4, 'phone', CASE WHEN len(d) = 11 THEN substr(d,1,3)||'-'||substr(d,4,4)||'-'||substr(d,8) WHEN len(d) = 10 AND d LIKE '02%' THEN substr(d,1,2)||'-'||substr(d,3,4)||'-'||substr(d,7)
    WHEN len(d) = 10 THEN substr(d,1,3)||'-'||substr(d,4,3)||'-'||substr(d,7) ELSE t END,
    CASE WHEN len(d) = 11 THEN substr(d,1,3)||'-****-'||substr(d,8) ELSE substr(t, 1, len(t) - 4) || '****' END, NULL FROM ph WHERE NOT bad
  UNION ALL SELECT {keys}, 3, 'card', t, CASE WHEN len(t) = 16 THEN t ELSE array_to_string(list_transform(string_split_regex(t, '(?:-|{_WS})'), lambda p, i: CASE WHEN i IN (2, 3) THEN '****' ELSE p END), '-') END, true FROM cd WHERE len(d) = 16 AND {_LUHN}
  UNION ALL SELECT {keys}, 2, 'account', t, regexp_replace(t, '-[^-]*$', '-****'), NULL FROM ac WHERE len(replace(t, '-', '')) >= 10
    AND NOT (len(split_part(t, '-', 1)) = 4 AND CAST(split_part(t, '-', 1) AS INT) BETWEEN 1900 AND 2099 AND CAST(split_part(t, '-', 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(split_part(t, '-', 3), 1, 2) AS INT) BETWEEN 1 AND 31)
  UNION ALL SELECT {keys}, 1, 'email', t, CASE WHEN strpos(t, '@') > 3 THEN substr(t,1,1) || repeat('*', strpos(t,'@') - 3) || substr(t, strpos(t,'@') - 1) ELSE substr(t,1,1) || '***' || substr(t, strpos(t,'@')) END, NULL FROM em
),
kept AS (SELECT {keys}, type, text, masked_text, verified FROM found QUALIFY row_number() OVER (PARTITION BY {part}, text ORDER BY pr DESC) = 1)"""



def _places(kind: str, pattern: str) -> str:
    """CTE ``kind(doc_id, page_index, n, t, pos)`` of a pattern's matches in the pages' text without white space; ``pos`` from 0."""
    return f"""
{kind}0 AS (SELECT doc_id, page_index, n, regexp_extract_all(n, '{pattern}') AS m, string_split_regex(n, '{pattern}') AS g FROM pg WHERE regexp_matches(n, '{pattern}')),
{kind}1 AS (SELECT doc_id, page_index, n, m, g, unnest(range(1, len(m) + 1)) AS k FROM {kind}0),
{kind} AS (SELECT doc_id, page_index, n, m[k] AS t, CAST(list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: len(x))), 0) AS BIGINT) AS pos FROM {kind}1),"""


#: Pages of fifty lines; ``ch`` has every character that isn't white space with its place in the page and its box.
_POSITIONED = rf"""
WITH RECURSIVE li AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
it AS (SELECT doc_id, i // 50 AS page_index, i, s, regexp_replace(s, '{_WS}+', '', 'g') AS p FROM li WHERE s <> ''),
pg AS (SELECT doc_id, page_index, string_agg(p, '' ORDER BY i) AS n FROM it GROUP BY 1, 2),
{_places("ph", _PHONE)}{_places("em", _EMAIL)}{_places("ac", r"\d{2,6}-\d{2,6}-\d{2,6}(?:-\d{1,3})?")}{_places("cd", _CARD)}
r0 AS (SELECT doc_id, page_index, regexp_replace(' ' || n || ' ', '([^A-Za-z0-9])', '\1\1', 'g') AS n FROM pg WHERE regexp_matches(n, '\d{{6}}-?\d{{7}}')),
r1 AS (SELECT doc_id, page_index, regexp_extract_all(n, '[^A-Za-z0-9]\d{{6}}(?:--)?\d{{7}}[^A-Za-z0-9]') AS m, string_split_regex(n, '[^A-Za-z0-9]\d{{6}}(?:--)?\d{{7}}[^A-Za-z0-9]') AS g FROM r0),
r2 AS (SELECT doc_id, page_index, m, g, unnest(range(1, len(m) + 1)) AS k FROM r1 WHERE len(m) > 0),
r3 AS (SELECT doc_id, page_index, m[k][2:len(m[k]) - 1] AS t, array_to_string(list_transform(range(1, k), lambda j: g[j] || m[j]), '') || g[k] || m[k][1] AS before FROM r2),
rr AS (SELECT doc_id, page_index, replace(t, '--', '-') AS t, replace(replace(t, '--', '-'), '-', '') AS d, len(before) - len(regexp_replace(before, '[A-Za-z0-9]', '', 'g')) // 2 - 1 AS pos FROM r3),
found AS (
  SELECT doc_id, page_index, 5 AS pr, 'rrn' AS type, pos, len(t) AS size, substr(d, 1, 6) || '-' || substr(d, 7) AS text, substr(d, 1, 6) || '-' || substr(d, 7, 1) || '******' AS masked_text,
    (11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, i, 1) AS INT) * [2,3,4,5,6,7,8,9,2,3,4,5][i])) % 11) % 10 = CAST(substr(d, 13, 1) AS INT) AS verified FROM rr
  UNION ALL SELECT doc_id, page_index, 4, 'phone', pos, len(t), CASE WHEN len(d) = 11 THEN substr(d,1,3)||'-'||substr(d,4,4)||'-'||substr(d,8) WHEN len(d) = 10 AND d LIKE '02%' THEN substr(d,1,2)||'-'||substr(d,3,4)||'-'||substr(d,7)
    WHEN len(d) = 10 THEN substr(d,1,3)||'-'||substr(d,4,3)||'-'||substr(d,7) ELSE t END, CASE WHEN len(d) = 11 THEN substr(d,1,3)||'-****-'||substr(d,8) ELSE substr(t, 1, len(t) - 4) || '****' END, NULL
    FROM (SELECT *, replace(t, '-', '') AS d FROM ph) WHERE NOT regexp_matches(substr(n, greatest(pos - 29, 1), least(pos, 30)), '[A-Za-z]$|{_LABEL}') AND NOT regexp_matches(substr(n, pos + len(t) + 1, 1), '^[A-Za-z0-9]')
  UNION ALL SELECT doc_id, page_index, 3, 'card', pos, len(t), t, CASE WHEN len(t) = 16 THEN t ELSE array_to_string(list_transform(string_split_regex(t, '(?:-|{_WS})'), lambda p, i: CASE WHEN i IN (2, 3) THEN '****' ELSE p END), '-') END, true
    FROM (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM cd) WHERE len(d) = 16 AND {_LUHN}
  UNION ALL SELECT doc_id, page_index, 2, 'account', pos, len(t), t, regexp_replace(t, '-[^-]*$', '-****'), NULL FROM ac WHERE len(replace(t, '-', '')) >= 10
    AND NOT (len(split_part(t, '-', 1)) = 4 AND CAST(split_part(t, '-', 1) AS INT) BETWEEN 1900 AND 2099 AND CAST(split_part(t, '-', 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(split_part(t, '-', 3), 1, 2) AS INT) BETWEEN 1 AND 31)
  UNION ALL SELECT doc_id, page_index, 1, 'email', pos, len(t), t, CASE WHEN strpos(t, '@') > 3 THEN substr(t,1,1) || repeat('*', strpos(t,'@') - 3) || substr(t, strpos(t,'@') - 1) ELSE substr(t,1,1) || '***' || substr(t, strpos(t,'@')) END, NULL FROM em
),
ch AS (
  SELECT doc_id, page_index, i, j, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i, j) - 1 AS c
  FROM (SELECT doc_id, page_index, i, generate_subscripts(q, 1) - 1 AS j, unnest(q) AS u FROM (SELECT doc_id, page_index, i, string_split(s, '') AS q FROM it SEMI JOIN found USING (doc_id, page_index))) WHERE NOT regexp_matches(u, '^{_WS}$')
),
bx AS (
  SELECT f.doc_id, f.page_index, pr, type, pos, text, masked_text, verified, min(j) * 6.0::DOUBLE AS x, min(700.0::DOUBLE - 14 * i) AS y, max(j) * 6.0::DOUBLE + 6 AS x2, max(712.0::DOUBLE - 14 * i) AS y2
  FROM found f JOIN ch ON ch.doc_id = f.doc_id AND ch.page_index = f.page_index AND ch.c >= f.pos AND ch.c < f.pos + f.size GROUP BY ALL
),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pr DESC, pos) AS k FROM bx),
gr AS (
  SELECT DISTINCT doc_id, page_index, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS held FROM o
  UNION ALL
  SELECT g.doc_id, g.page_index, o.k, CASE WHEN len(list_filter(held, lambda h: greatest(0.0::DOUBLE, least(o.x2, h.x2) - greatest(o.x, h.x)) * greatest(0.0::DOUBLE, least(o.y2, h.y2) - greatest(o.y, h.y)) / ((o.x2 - o.x) * (o.y2 - o.y)) > 0.5)) > 0 THEN held
    ELSE list_append(held, {{'k': o.k, 'x': o.x, 'y': o.y, 'x2': o.x2, 'y2': o.y2}}) END
  FROM gr g JOIN o ON o.doc_id = g.doc_id AND o.page_index = g.page_index AND o.k = g.k + 1
),
ends AS (SELECT doc_id, page_index, held FROM gr QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY k DESC) = 1),
kept AS (SELECT doc_id, page_index, generate_subscripts(held, 1) - 1 AS seq, unnest(held).k AS k FROM ends)
SELECT doc_id, page_index, seq, type, text, masked_text, verified, x, y, x2 - x AS width, y2 - y AS height FROM kept JOIN o USING (doc_id, page_index, k)
"""

_DOCS = "WITH" + _detections("documents", "doc_id")
QUERIES = {f.__name__: f for f in (pii_preview, pii_counts, pii_counts_by_lang, pii_conversations, pii_email_mask, pii_card_luhn_mask, pii_phone_context, pii_label_context, pii_signed_turns, pii_fixture_rrn, pii_fixture_account, pii_fixture_email, pii_positioned)}
SQL = {
    "pii_positioned": _POSITIONED,
    "pii_preview": _DOCS + " SELECT doc_id, type, text, masked_text, verified FROM kept",
    "pii_counts": _DOCS + " SELECT v.type, count(kept.type) AS n FROM (VALUES ('rrn'), ('phone'), ('card'), ('account'), ('email')) v(type) LEFT JOIN kept ON kept.type = v.type GROUP BY v.type",
    "pii_counts_by_lang": "WITH" + _detections("documents", "doc_id, lang") + " SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM kept GROUP BY lang, type",
    "pii_conversations": "WITH" + _detections("conversations", "conv_id, turn") + " SELECT conv_id, turn, type, text, masked_text, verified FROM kept",
    "pii_email_mask": _DOCS + " SELECT DISTINCT doc_id, text, masked_text FROM found WHERE type = 'email'",
    "pii_card_luhn_mask": _DOCS + " SELECT DISTINCT doc_id, text, masked_text, verified FROM found WHERE type = 'card'",
    "pii_phone_context": _DOCS + " SELECT doc_id, pos AS start, t AS text, bad AS suppressed FROM ph",
    "pii_fixture_rrn": """WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey % 1000000 * 7919104729 % 10000000000000 AS VARCHAR), 13, '0') AS d FROM customer),
      t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN substr(d, 1, 7) WHEN c_custkey % 2 = 0 THEN substr(d, 1, 6) || '-' || substr(d, 7) ELSE d END AS s FROM n), v AS (SELECT c_custkey, s, replace(s, '-', '') AS d FROM t)
      SELECT c_custkey, s, CASE WHEN len(d) < 13 THEN s ELSE substr(d,1,6) || '-' || substr(d,7,1) || '******' END AS masked, CASE WHEN len(d) <> 13 THEN s ELSE substr(d,1,6) || '-' || substr(d,7) END AS formatted,
      coalesce(len(d) = 13 AND (11 - list_sum(list_transform(range(1, 13), lambda i: TRY_CAST(substr(d, i, 1) AS INT) * [2,3,4,5,6,7,8,9,2,3,4,5][i])) % 11) % 10 = TRY_CAST(substr(d, 13, 1) AS INT), false) AS valid FROM v""",
    "pii_label_context": "WITH l AS (SELECT s_suppkey, s_name, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS d, [" + ", ".join(f"'{x}'" for x in _LABELS) + f"][s_suppkey % {len(_LABELS)} + 1] AS label FROM supplier), labelled AS (SELECT s_suppkey, label || '010-' || substr(d, 1, 4) || '-' || substr(d, 5) || ' ' || s_name AS text FROM l)," + _detections("labelled", "s_suppkey") + " SELECT s_suppkey, type, text, masked_text, verified FROM kept",
    "pii_signed_turns": r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, lpad(CAST((conv_id * 7919 + turn * 104729) % 100000000 AS VARCHAR), 8, '0') AS n FROM conversations),
      signed AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN chr(10) || 'phone 010 ' || substr(n, 1, 4) || ' ' || substr(n, 5) || '!' WHEN turn % 3 = 1 THEN chr(10) || 'mail u' || n || '@mail' || turn || '.example.org now'
        ELSE chr(10) || 'account 110-234-' || n || ' card ' || substr(n, 1, 4) || '-4111-1111-1111' END AS text FROM c),""" + _detections("signed", "conv_id, turn") + " SELECT conv_id, turn, type, text, masked_text, verified FROM kept",
    "pii_fixture_email": """SELECT c_custkey, s, CASE WHEN split_part(s, '@', 2) = '' THEN s WHEN len(split_part(s, '@', 1)) > 2 THEN substr(s, 1, 1) || repeat('*', len(split_part(s, '@', 1)) - 2) || substr(split_part(s, '@', 1), -1) || '@' || split_part(s, '@', 2) ELSE substr(split_part(s, '@', 1), 1, 1) || '***@' || split_part(s, '@', 2) END AS masked
      FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 1, c_custkey % 5) || '@' WHEN 2 THEN substr(c_name, 1, c_custkey % 5) || '@y@' || c_mktsegment ELSE substr(c_name, 1, c_custkey % 5) || '@' || c_mktsegment || '.kr' END AS s FROM customer)""",
    "pii_fixture_account": """SELECT c_custkey, s, CASE WHEN contains(s, '-') THEN regexp_replace(s, '-[^-]*$', '-****') ELSE substr(s, 1, greatest(len(s) - 4, 0)) || '****' END AS masked, len(replace(s, '-', '')) AS n_digits,
      coalesce(len(split_part(s,'-',1)) = 4 AND TRY_CAST(split_part(s,'-',1) AS INT) BETWEEN 1900 AND 2099 AND TRY_CAST(split_part(s,'-',2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(substr(split_part(s,'-',3),1,2) AS INT) BETWEEN 1 AND 31, false) AS date_shaped
      FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '110-234-' || n WHEN 1 THEN (c_custkey % 300 + 1850) || '-' || (c_custkey % 14) || '-' || n WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE n || n END AS s FROM (SELECT c_custkey, lpad(CAST(c_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') AS n FROM customer))""",
}
