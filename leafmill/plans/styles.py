"""Queries on fonts, colours, sizes and CSS; values derived from parts stand in for documents' styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import styles as S
from leafmill.functions import text as X
from leafmill.sources.tables import table

_K = "p_partkey"
_NAMES = ["ABCDEF+Arial-Bold", "XYZ+Q+HCR Batang", "맑은 고딕", "", "Times-Roman", "Liberation-Serif", "X+", "Courier New", " Foo-Bar ", "Nimbus Sans L"]
_COLOURS = ["#12Ab9f", "ffffff", "", "none", "#12345", " #000080 ", "#gggggg"]


def _pick(values: list[str], step: int = 1) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(_K) * step % len(values) + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_K, "p_size", "p_name", "p_type")


def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pick(_NAMES)
    return _parts(spark, sf_dir).select(_K, S.document_font(n).alias("document"), S.export_font(n, "Batang").alias("export"))


def colour_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _pick(_COLOURS, 3)
    rgb = S.rgb_of_hex(c)
    size = F.col("p_size").cast("double")
    return _parts(spark, sf_dir).select(_K, F.round(rgb.r, 6).alias("r"), F.round(rgb.b, 6).alias("b"), S.hwp_colour(c).alias("hwp"), S.colour_of_channels(size, size * 3, size * 5).alias("bytes"), S.colour_of_channels(size / 50, size / 100, F.lit(0.0)).alias("unit"))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = S.page_size_mm((F.col(_K) % 5 * 200).cast("double"), (F.col(_K) % 3 * 500 - 400).cast("double"))
    t = F.when(F.col(_K) % 4 == 0, "x1").otherwise((F.col("p_size") * 37).cast("string"))
    return _parts(spark, sf_dir).select(_K, w.alias("width"), h.alias("height"), S.hwp_of_mm(F.col("p_size").cast("double")).alias("units"), S.pt_of_hwp(t, 10.0).alias("pt"))


def style_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSS of character, paragraph and cell styles whose attributes come and go with the key, and whether the style is a heading."""
    k, s = F.col(_K), F.col("p_size")
    has = lambda n, name, v: F.when(k % n == 0, F.struct(F.lit(name).alias("k"), v.cast("string").alias("v")))
    entries = F.array(has(2, "height", s * 100), has(3, "textColor", F.lit("#123456")), has(5, "shadeColor", F.lit("none")), has(4, "bold", k % 8 / 4), has(7, "underline", F.lit("BOTTOM")), has(6, "ratio", s + 50), has(9, "spacing", s * -10), has(10, "faceNameHangul", F.lit("바탕")), has(15, "faceNameLatin", F.lit("바탕")), has(11, "faceNameLatin", F.lit("Arial")))
    # Equal names: the last entry counts.
    entries = F.filter(entries, lambda e: e.isNotNull())
    entries = X.bound(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o.k == e.k)))
    chars = F.map_from_entries(F.transform(entries, lambda e: F.struct(e.k, F.when(e.k == "bold", F.regexp_replace(e.v, r"\.0$", "")).otherwise(e.v))))
    side = lambda t, w: F.struct(F.lit(t).alias("type"), w.alias("width"), F.lit("#222").alias("colour"))
    sides = F.when(k % 3 > 0, F.create_map(F.lit("top"), side("SINGLE", s / 10.0), F.lit("left"), side("NONE", s / 10.0), F.lit("bottom"), side("DASH", F.lit(0.5))))
    names = _pick(["본문", "큰 제목", "Heading 1", "Subtitle", "머리말2", "Normal"])
    return _parts(spark, sf_dir).repartition(_K).select(_K, X.bound(chars, S.char_css).alias("char"), S.para_css(_pick(["LEFT", "CENTER", "DISTRIBUTED", "ODD"])).alias("para"), S.border_css(sides, F.when(k % 2 == 0, "#eee")).alias("border"), S.is_heading(names).alias("heading"))


def _sql_pick(values: list[str], step: int = 1) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][p_partkey * {step} % {len(values)} + 1]"


_TENTH = "CAST(CAST(round({}, 1) AS DECIMAL(18, 1)) AS VARCHAR)"
QUERIES = {f.__name__: f for f in (font_families, colour_numbers, page_sizes, style_css)}
SQL = {
    "font_families": "SELECT p_partkey, "
    + _sql_pick(["Arial", "Batang", "Malgun Gothic", "", "Times New Roman", "Liberation-Serif", "", "Courier New", " Foo-Bar ", "Nimbus Sans L"])
    + " AS document, "
    + _sql_pick(["Nimbus Sans", "Q+HCR Batang", "맑은 고딕", "Batang", "Nimbus Roman", "Nimbus Roman", "Batang", "Nimbus Mono PS", "Foo Bar", "Nimbus Sans"])
    + " AS export FROM part",
    "colour_numbers": f"""WITH p AS (SELECT p_partkey, p_size AS s, ltrim(trim({_sql_pick(_COLOURS, 3)}), '#') AS c FROM part), q AS (SELECT *, regexp_full_match(c, '(?i)[0-9a-f]{{6}}') AS ok FROM p),
      n AS (SELECT *, CASE WHEN ok THEN CAST('0x' || substr(c, 1, 2) AS INT) END AS r0, CASE WHEN ok THEN CAST('0x' || substr(c, 3, 2) AS INT) END AS g0, CASE WHEN ok THEN CAST('0x' || substr(c, 5, 2) AS INT) END AS b0 FROM q)
      SELECT p_partkey, round(r0 / 255.0::DOUBLE, 6) AS r, round(b0 / 255.0::DOUBLE, 6) AS b, CAST(coalesce(b0 * 65536 + g0 * 256 + r0, 0) AS INT) AS hwp, format('#{{:02X}}{{:02X}}{{:02X}}', CAST(s AS BIGINT) & 255, CAST(s * 3 AS BIGINT) & 255, CAST(s * 5 AS BIGINT) & 255) AS bytes,
        format('#{{:02X}}{{:02X}}00', CAST(round_even(s / 50.0::DOUBLE * 255, 0) AS BIGINT), CAST(round_even(s / 100.0::DOUBLE * 255, 0) AS BIGINT)) AS unit FROM n""",
    "page_sizes": """WITH p AS (SELECT p_partkey, p_size, floor(CAST(p_partkey % 5 * 200 AS DOUBLE) * 25.4::DOUBLE / 96 * 1000 + 0.5) / 1000 AS w, floor(CAST(p_partkey % 3 * 500 - 400 AS DOUBLE) * 25.4::DOUBLE / 96 * 1000 + 0.5) / 1000 AS h FROM part)
      SELECT p_partkey, CASE WHEN w > 0 THEN w ELSE 210 END AS width, CASE WHEN h > 0 THEN h ELSE 297 END AS height, CAST(round(p_size * 7200 / 25.4::DOUBLE) AS BIGINT) AS units, CASE WHEN p_partkey % 4 = 0 THEN 10.0::DOUBLE ELSE p_size * 37 / 100.0::DOUBLE END AS pt FROM p""",
    "style_css": f"""WITH p AS (SELECT p_partkey, p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 11 = 0 THEN 'Arial' WHEN p_partkey % 15 = 0 THEN '바탕' END AS la, CASE WHEN p_partkey % 10 = 0 THEN '바탕' END AS ko FROM part),
      f AS (SELECT *, concat_ws(',', ko, CASE WHEN la IS NOT NULL AND (ko IS NULL OR la <> ko) THEN la END) AS faces FROM p)
      SELECT p_partkey, concat_ws(';', CASE WHEN k % 2 = 0 AND s <> 10 THEN 'font-size:' || {_TENTH.format("s * 1.0")} || 'pt' END, CASE WHEN k % 3 = 0 THEN 'color:#123456' END, CASE WHEN k % 8 = 4 THEN 'font-weight:bold' END, CASE WHEN k % 7 = 0 THEN 'text-decoration:underline' END,
          CASE WHEN k % 6 = 0 AND s <> 50 THEN 'font-size:' || (s + 50) || '%' END, CASE WHEN k % 9 = 0 THEN 'letter-spacing:' || {_TENTH.format("s / -10.0")} || 'pt' END,
          CASE WHEN faces <> '' THEN 'font-family:' || faces || ',''맑은 고딕'',''Apple SD Gothic Neo'',sans-serif' END) AS char,
        {_sql_pick(["text-align:left", "text-align:center", "text-align:justify", ""])} AS para,
        CASE WHEN k % 3 = 0 THEN 'border:1px solid #000' ELSE 'border-top:' || {_TENTH.format("s / 10.0")} || 'pt solid #222;border-right:none;border-bottom:0.5pt solid #222;border-left:none' || CASE WHEN k % 2 = 0 THEN ';background-color:#eee' ELSE '' END END AS border,
        p_partkey % 6 IN (1, 2, 3, 4) AS heading FROM f""",
}
