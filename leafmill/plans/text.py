"""Queries on markup, text and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.accounts import skip_histogram as histogram
from leafmill.plans.markdown import _inline
from leafmill.sources.tables import table


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text: script and style away, then entities decoded and white space collapsed."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    return table(spark, sf_dir, "pages").select("page_id", X.normal_word(bare).alias("text"))


def _tags(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("seq", "attrs"))


def html_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of all tags, counted by name."""
    tags = _tags(spark, sf_dir, r"<[a-zA-Z][a-zA-Z0-9]*\b([^>]*)>")
    return tags.select("page_id", F.explode(X.attributes(F.col("attrs"))).alias("name", "value")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("page_id").alias("n_pages"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with fragments and queries cut off, resolved below the site's root."""
    a = _tags(spark, sf_dir, r"<a\b([^>]*)>").select("page_id", "seq", X.attributes(F.col("attrs"))["href"].alias("href"))
    return a.where("href is not null").select("page_id", "seq", "href", X.clean_href(F.col("href")).alias("path"), X.normal_path(X.clean_href(F.col("href"))).alias("resolved"), X.dirname(X.clean_href(F.col("href"))).alias("dir"))


def html_blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at least 40 characters of text besides white space."""
    return html_text(spark, sf_dir).select("page_id", F.length(F.regexp_replace("text", X.WS, "")).cast("long").alias("n")).where("n >= 40")


def skip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    reason = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "fragment").when(~F.col("html").contains("<p"), "no paragraph")
    return histogram(p, reason)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_blocks(F.col("text"), F.col("doc_id") % 3, F.col("doc_id") % 2 + 1)).alias("seq", "text"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.min_by("text", "seq").alias("first"), F.max_by("text", "seq").alias("last"))


def word_normal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations after entity decoding and collapsing, counted by role."""
    c = table(spark, sf_dir, "conversations").select("role", X.normal_word(F.col("text")).alias("t"))
    return c.groupBy("role").agg(F.sum(F.size(F.split("t", " "))).cast("long").alias("words"), F.sum(F.length("t")).cast("long").alias("chars"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", "url", X.clean_href(F.col("url")).alias("bare"))
    path = F.regexp_replace("bare", "^https?://[^/]*", "")
    return u.select("page_id", F.lower(F.regexp_extract("url", "^(https?)://", 1)).alias("scheme"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), path.alias("path"), X.safe_redirect(path).alias("redirect"), X.inside_root(F.regexp_replace(path, "^/", "")).alias("inside"))


def _pick(n: Column, values: tuple) -> Column:
    """One of the values, by a number."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n % len(values)).cast("int"))


def markdown_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn between marks of all kinds."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    turn = F.col("turn").cast("string")
    s = F.concat(F.lit("**"), "role", F.lit("** _"), turn, F.lit("_ "), "text", F.lit(" `"), turn, F.lit("` snake_case_name ![i "), turn, F.lit("](a.png) [*l*](u_"), turn, F.lit(") __x__"))
    return c.select("conv_id", "turn", X.markdown_inline(s).alias("html"))


def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn escaped, with breaks, tags and characters by number around it, decoded again."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    code = F.col("turn") % 26 + 65
    escaped = F.replace(X.escape_html(F.col("text")), F.lit("&#39;"), F.lit("&apos;"))
    s = F.concat(F.lit("&#"), code.cast("string"), F.lit(";&#x"), F.hex(code + 32), F.lit("; "), escaped, F.lit("<br/><b class='x'>&amp;lt;</b>&#54620;&amp;#xAE00;"))
    return c.select("conv_id", "turn", X.decode_entities(s).alias("text"))


def odf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's names between ODF spaces, tabs and breaks."""
    gap = (F.col("p_partkey") % 5).cast("string")
    s = F.concat(F.lit(" "), "p_name", F.lit('<text:s text:c="'), gap, F.lit('"/>'), "p_brand", F.lit("<text:tab/><text:span>"), "p_type", F.lit("</text:span><text:s/>&amp; <text:line-break/>  "), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", X.decode_odf(s).alias("text"))


_UNITS = ("in", "cm", "mm", "pt", "", "px", "em", "IN")


def odf_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's size as a length in one of the units, some below nothing, some in none."""
    k = F.col("p_partkey")
    s = F.concat(F.when(k % 3 == 0, "-").otherwise(""), F.col("p_size").cast("string"), F.when(k % 5 == 0, ".5").otherwise(""), _pick(k, _UNITS))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.odf_px(s), 6).alias("px"), F.round(X.odf_pt(s), 6).alias("pt"))


_EXTENSIONS = (".png", ".SVG", ".jpeg", ".tar.gz", "", ".webp")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a path: upward steps, empty and dotted parts, with names that hold blanks."""
    k = F.col("p_partkey")
    s = F.concat(_pick(k, ("./", "../../", "a//", "")), "p_name", F.lit("/"), "p_brand", _pick(k, ("/../", "/", "/./")), k.cast("string"), _pick(k, _EXTENSIONS))
    below = F.concat(F.regexp_replace("p_name", " ", "%20"), F.lit("/../"), k.cast("string"), F.lit("+x%2"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", s.alias("s"), below.alias("r"))
    s = F.col("s")
    return p.select("p_partkey", X.normal_path(s).alias("normal"), X.dirname(s).alias("dir"), X.mime_type(s).alias("mime"), X.without_extension(s).alias("bare"), X.resolve_path(F.lit("root/x/"), F.regexp_replace("p_name", " ", "%20")).alias("below"), X.resolve_path(F.lit("root/"), F.col("r")).alias("raw"))


#: Names of fonts and the families they become.
_FONTS = (("Arial-Bold", "Nimbus Sans"), ("HCR Batang", "Batang"), ("맑은 고딕", "Malgun Gothic"), ("", "함초롬바탕"), ("Noto Sans CJK", "Noto Sans CJK KR"), ("Foo", None), ("TimesNewRoman", "Nimbus Roman"), ("Courier", "Nimbus Mono PS"))


def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's brand behind a font's name, some of them as subsets."""
    k = F.col("p_partkey")
    name = _pick(k, tuple(a for a, _ in _FONTS))
    s = F.when(name == "", "").otherwise(F.concat(F.when(k % 3 == 0, "ABCDEF+").otherwise(""), name, F.lit(" "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", X.normal_font(s).alias("family"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a line and as a message of at most 80 characters, which is what these are for."""
    s = F.concat(F.lit("  "), "text", F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitize_line(s, 80).alias("line"), X.sanitize_message(s, 80).alias("message"))


def cookie_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a cookie header of some of three names."""
    k = F.col("c_custkey")
    s = F.concat(F.when(k % 3 > 0, F.concat(F.lit("a="), k.cast("string"), F.lit("; "))).otherwise(""), F.lit("b=x="), "c_name", F.lit(";nothing; =no"), F.when(k % 2 == 0, F.concat(F.lit(";  sid="), "c_mktsegment")).otherwise(""))
    c = table(spark, sf_dir, "customer").select("c_custkey", X.cookies(s).alias("m"))
    return c.select("c_custkey", *(F.col("m")[n].alias(n) for n in ("a", "b", "sid")))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's key as a colour's number, its size as channels."""
    k, part = F.col("p_partkey"), F.col("p_size") / F.lit(40.0)
    return table(spark, sf_dir, "part").select("p_partkey", X.colour_of_int(k * 7919 + 16711680).alias("hex"), X.colour_of_rgb(part, part - 0.5, F.lit(1.0) - part).alias("rgb"))


def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as wide and high as parts' sizes and keys make them, with a stamp in a corner."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37.0).alias("w"), (F.col("p_partkey") % 1600 + 1.0).alias("h"))
    w, h, pw, ph = X.image_fit(F.col("w"), F.col("h"))
    x, y = X.corner(F.lit("top-right"), pw, ph, F.lit(20.0), F.lit(10.0))
    held = X.clamp(F.col("h"), 50.0, F.col("w"))
    return p.select("p_partkey", "w", "h", F.round(w, 6).alias("img_w"), F.round(h, 6).alias("img_h"), F.round(pw, 6).alias("page_w"), F.round(ph, 6).alias("page_h"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), held.alias("held"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit conversions of part sizes."""
    s = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.px_to_mm(s).alias("mm"), X.hwp_of_cm(s).alias("hwp_cm"), X.hwp_of_pt(s).alias("hwp_pt"), F.round(X.mm_of_hwp(s), 6).alias("hwp_mm"), X.saved_percent(F.lit(60.0), s).alias("saved"))


_BLOCK = "regexp_replace({}, '(?:\\s|[\\x{{00a0}}\\x{{3000}}\\x{{feff}}])+$', '')"
_BARE = r"regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g')"
_DECODE = "replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_TEXT = f"trim(regexp_replace({_DECODE.format(_BARE)}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"

QUERIES = {
    "html_text": html_text, "html_attrs": html_attrs, "html_links": html_links, "html_blank_filter": html_blank_filter, "skip_histogram": skip_histogram, "text_blocks": text_blocks,
    "word_normal_counts": word_normal_counts, "url_parts": url_parts, "markdown_inline": markdown_inline, "xml_entities": xml_entities, "odf_text": odf_text, "odf_lengths": odf_lengths, "paths": paths,
    "fonts": fonts, "clean_lines": clean_lines, "cookie_values": cookie_values, "colours": colours, "image_fit": image_fit, "units": units,
}
SQL = {
    "html_text": f"SELECT page_id, {_TEXT} AS text FROM pages",
    "html_attrs": r"""WITH t AS (SELECT page_id, row_number() OVER () AS r, tag FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*\b([^>]*)>', 1)) AS tag FROM pages)),
      a AS (SELECT page_id, r, generate_subscripts(n, 1) AS i, unnest(n) AS name, unnest(v) AS value FROM (SELECT page_id, r, regexp_extract_all(tag, '([\w:-]+)="([^"]*)"', 1) AS n, regexp_extract_all(tag, '([\w:-]+)="([^"]*)"', 2) AS v FROM t)),
      l AS (SELECT page_id, name, value FROM a QUALIFY row_number() OVER (PARTITION BY r, name ORDER BY i DESC) = 1)
      SELECT name, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT page_id) AS n_pages FROM l GROUP BY name""",
    "html_links": r"""WITH t AS (SELECT page_id, a, generate_subscripts(a, 1) - 1 AS seq, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<a\b([^>]*)>', 1) AS a FROM pages)),
      h AS (SELECT page_id, seq, regexp_extract(tag, '(?:^|\s)href="([^"]*)"', 1) AS href, split_part(split_part(regexp_extract(tag, '(?:^|\s)href="([^"]*)"', 1), '#', 1), '?', 1) AS path FROM t WHERE regexp_matches(tag, '(?:^|\s)href="'))
      SELECT page_id, CAST(seq AS INT) AS seq, href, path, array_to_string(list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.')), '/') AS resolved, regexp_extract(path, '^(.*/)?', 1) AS dir FROM h""",
    "html_blank_filter": f"SELECT page_id, n FROM (SELECT page_id, len(regexp_replace({_TEXT}, '\\s', '', 'g')) AS n FROM pages) WHERE n >= 40",
    "skip_histogram": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' WHEN NOT contains(html, '<p') THEN 'no paragraph' END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY 1",
    "text_blocks": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS b FROM documents),
      m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN list_prepend('[' || (doc_id % 3 + 1) || '페이지]', b) WHEN len(b) = 0 THEN ['PDF에서 추출 가능한 텍스트가 없습니다. 스캔 이미지 PDF는 OCR 단계가 필요합니다.'] ELSE b END AS b FROM l)
      SELECT doc_id, len(b) AS n_blocks, b[1] AS first, b[-1] AS last FROM m""",
    "word_normal_counts": f"WITH t AS (SELECT role, trim(regexp_replace({_DECODE.format('text')}, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT role, CAST(sum(len(string_split(t, ' '))) AS BIGINT) AS words, CAST(sum(len(t)) AS BIGINT) AS chars FROM t GROUP BY role",
    "url_parts": r"""WITH u AS (SELECT page_id, url, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://[^/]*', '') AS path FROM pages)
      SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, path, CASE WHEN path LIKE '/%' AND path NOT LIKE '//%' THEN path ELSE '/' END AS redirect,
      regexp_replace(path, '^/', '') <> '' AND NOT regexp_matches(regexp_replace(path, '^/', ''), '(?i)^[a-z][a-z0-9+.-]*:') AND NOT contains(path, '..') AS inside FROM u""",
    "markdown_inline": "SELECT conv_id, turn, " + _inline("'**' || coalesce(role, '') || '** _' || turn || '_ ' || coalesce(text, '') || ' `' || turn || '` snake_case_name ![i ' || turn || '](a.png) [*l*](u_' || turn || ') __x__'") + " AS html FROM conversations",
    "xml_entities": "SELECT conv_id, turn, chr(CAST(turn % 26 + 65 AS INT)) || chr(CAST(turn % 26 + 97 AS INT)) || ' ' || coalesce(text, '') || chr(10) || '&lt;한글' AS text FROM conversations",
    "odf_text": "SELECT p_partkey, p_name || repeat(' ', greatest(1, CAST(p_partkey % 5 AS INT))) || p_brand || chr(9) || p_type || ' &' || chr(10) || p_name AS text FROM part",
    "odf_lengths": f"""WITH u AS (SELECT p_partkey, (p_size + CASE WHEN p_partkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END) * CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS v, [{', '.join(f"'{u.lower()}'" for u in _UNITS)}][p_partkey % {len(_UNITS)} + 1] AS u FROM part)
      SELECT p_partkey, round(CASE u WHEN 'em' THEN 0 ELSE v * CASE u WHEN 'in' THEN 96 WHEN 'cm' THEN 96 / 2.54::DOUBLE WHEN 'mm' THEN 96 / 25.4::DOUBLE WHEN 'pt' THEN 96 / 72.0::DOUBLE ELSE 1 END END, 6) AS px,
        round(CASE u WHEN 'em' THEN 12 ELSE v * CASE u WHEN 'in' THEN 72 WHEN 'cm' THEN 72 / 2.54::DOUBLE WHEN 'mm' THEN 72 / 25.4::DOUBLE WHEN 'px' THEN 0.75::DOUBLE ELSE 1 END END, 6) AS pt FROM u""",
    "paths": f"""WITH q AS (SELECT *, p_partkey AS k, [{', '.join(f"'{e}'" for e in _EXTENSIONS)}][p_partkey % {len(_EXTENSIONS)} + 1] AS e FROM part)
      SELECT p_partkey, CASE k % 4 WHEN 2 THEN 'a/' ELSE '' END || p_name || CASE k % 3 WHEN 0 THEN '/' ELSE '/' || p_brand || '/' END || k || e AS normal,
        ['./', '../../', 'a//', ''][k % 4 + 1] || p_name || '/' || p_brand || ['/../', '/', '/./'][k % 3 + 1] AS dir, ['image/png', 'image/svg+xml', 'image/jpeg', NULL, NULL, 'image/webp'][k % 6 + 1] AS mime,
        CASE WHEN e = '.tar.gz' THEN ['./', '../../', 'a//', ''][k % 4 + 1] || p_name || '/' || p_brand || ['/../', '/', '/./'][k % 3 + 1] || k || '.tar' WHEN e <> '' THEN ['./', '../../', 'a//', ''][k % 4 + 1] || p_name || '/' || p_brand || ['/../', '/', '/./'][k % 3 + 1] || k
          ELSE regexp_replace(['./', '../../', 'a//', ''][k % 4 + 1] || p_name || '/' || p_brand || ['/../', '/', '/./'][k % 3 + 1] || k, '\\.[^.]+$', '') END AS bare,
        'root/x/' || p_name AS below, 'root/' || k || '+x%2' AS raw FROM q""",
    "fonts": f"SELECT p_partkey, CASE WHEN f = '' THEN 'Foo ' || p_brand ELSE f END AS family FROM (SELECT *, [{', '.join(chr(39) + (b or '') + chr(39) for _, b in _FONTS)}][p_partkey % {len(_FONTS)} + 1] AS f FROM part)",
    "clean_lines": r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '(^[\s\x{00a0}\x{3000}\x{feff}]+)|([\s\x{00a0}\x{3000}\x{feff}]+$)', '', 'g'), '[\s\x{00a0}\x{3000}\x{feff}]+', ' ', 'g'), 1, 80) AS line,
      substr(regexp_replace(replace(text, chr(13), ''), '(^[\s\x{00a0}\x{3000}\x{feff}]+)|([\s\x{00a0}\x{3000}\x{feff}]+$)', '', 'g'), 1, 80) AS message FROM documents""",
    "cookie_values": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS VARCHAR) END AS a, 'x=' || c_name AS b, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS sid FROM customer",
    "colours": """SELECT p_partkey, '#' || lpad(upper(to_hex((p_partkey * 7919 + 16711680) & 16777215)), 6, '0') AS hex,
      '#' || array_to_string(list_transform([p_size / 40.0::DOUBLE, p_size / 40.0::DOUBLE - 0.5::DOUBLE, 1.0::DOUBLE - p_size / 40.0::DOUBLE], lambda c: lpad(upper(to_hex(CAST(round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) * 255, 0) AS BIGINT))), 2, '0')), '') AS rgb FROM part""",
    "image_fit": "WITH f AS (SELECT p_partkey, w, h, least(1.0, 600 / w, 800 / h) AS k FROM (SELECT p_partkey, p_size * 37.0::DOUBLE AS w, p_partkey % 1600 + 1.0::DOUBLE AS h FROM part)) SELECT p_partkey, w, h, round(w * k, 6) AS img_w, round(h * k, 6) AS img_h, round(w * k + 100, 6) AS page_w, round(h * k + 100, 6) AS page_h, round(w * k + 100 - 20 - 50, 6) AS x, round(h * k + 100 - 10 - 50, 6) AS y, greatest(50.0::DOUBLE, least(w, h)) AS held FROM f",
    "units": "SELECT p_partkey, floor(CAST(p_size AS DOUBLE) * CAST(25.4 AS DOUBLE) / 96 * 1000 + 0.5) / 1000 AS mm, CAST(trunc(p_size / 2.54 * 7200) AS BIGINT) AS hwp_cm, CAST(p_size * 100 AS BIGINT) AS hwp_pt, round(p_size / 7200.0 * 25.4, 6) AS hwp_mm, CAST(greatest(0, floor((1 - p_size / 60.0) * 100 + 0.5)) AS BIGINT) AS saved FROM part",
}
