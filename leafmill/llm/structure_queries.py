"""Registered queries over manifests, archives and conversation tries, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import merkle, prefix_trie, warc
from leafmill.llm._store import discard, stored
from leafmill.sources.scratch import scratch_path
from leafmill.sources.tables import table


def _crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document, the languages being the groups.

    Nulls in any column count as ``-``; a null doc_id is never tampered with; repeated rows are leaves of their own; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n: merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    changed = F.when((_crc(F.col("doc_id")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)).otherwise("")
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf(F.col("n_chars")).alias("leaf"), changed.alias("extra"))
    out = merkle.manifest(rows)
    again = merkle.folded(F.when(F.col("extra") == "", F.col("leaf")).otherwise(F.col("extra")), F.col("sibs"))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("sibs")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, one row a capture.

    A null text is an empty payload; pages whose id is null come back without one; pages that repeat the largest id of an equal payload, URL
    included, are responses all; an empty table gives no rows.
    """
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    # Payloads of captures are digested where they are read; what follows needs the metadata's only.
    records = records.withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload")))
    page = F.regexp_extract(F.element_at("metadata", 1)["payload"].cast("string"), r"(?m)^page_id: (-?\d+)\r?$", 1)
    captures = warc.captures(records).where("size(metadata) > 0").select(F.nullif(page, F.lit("")).cast("long").alias("page_id"), "capture.id", "capture.type", "capture.refers_to", "capture.payload_bytes", "capture.payload_digest")
    captures = stored(captures)
    sources = captures.where("type = 'response'").groupBy(F.col("id").alias("of")).agg(F.max("page_id").alias("source"))
    out = captures.join(sources, F.col("refers_to") == F.col("of"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("source").alias("refers_to"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row a node.

    Null turns come first, equal turns by the hash of role and text; null roles and texts are empty; rows without a conversation id belong to none
    and are left out; an empty table gives no rows.
    """
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    own = stored(prefix_trie.positions(messages))
    sizes = stored(own.groupBy("conv").agg(F.max("size").alias("size")))
    convs = sizes.select("conv", (_crc(F.col("conv")) % 9).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    plan = convs.join(sizes.select(F.col("conv").alias("base"), "size"), "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("size", F.lit(0))).alias("lead"))
    heads = plan.join(own.where("pos <= 8").select(F.col("conv").alias("base"), "pos", "turn_hash", "tokens"), "base").where("pos <= h").select("conv", "pos", "turn_hash", "tokens")
    tails = own.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "turn_hash", "tokens")
    turns = stored(heads.unionByName(tails))
    out = prefix_trie.trie(turns, sizes.select("conv"))
    discard(own, turns, sizes)
    return out


def _crc_sql(value: str) -> str:
    """CRC-32 of a number's decimal text, bit by bit; ``tab`` is the list of the 256 remainders."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


_TAB = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS tab)"


def _leaf_sql(n: str) -> str:
    one = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(one, ('doc_id', 'source', 'lang', n, 'text')))})"


OP11_SQL = f"""
WITH RECURSIVE {_TAB},
d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_crc_sql('doc_id')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE '' END AS extra
  FROM documents, tab
),
l AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, extra) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n
),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n
),
tl AS (SELECT DISTINCT g, lvl FROM t WHERE n > 1),
ul AS (SELECT DISTINCT lvl FROM u WHERE n > 1),
p AS (
  SELECT l.g, l.i, tl.lvl, CASE WHEN x.h IS NULL THEN 'N' WHEN (l.i >> tl.lvl) & 1 = 1 THEN 'L' || x.h ELSE 'R' || x.h END AS step
  FROM l JOIN tl USING (g) LEFT JOIN t x ON x.g = l.g AND x.lvl = tl.lvl AND x.i = xor(l.i >> tl.lvl, 1)
  UNION ALL
  SELECT l.g, l.i, 1000 + ul.lvl, CASE WHEN x.h IS NULL THEN 'N' WHEN (s.i >> ul.lvl) & 1 = 1 THEN 'L' || x.h ELSE 'R' || x.h END
  FROM l JOIN s USING (g) CROSS JOIN ul LEFT JOIN u x ON x.lvl = ul.lvl AND x.i = xor(s.i >> ul.lvl, 1)
),
q AS (SELECT g, i, list(step ORDER BY lvl) AS steps FROM p GROUP BY g, i),
f AS (
  SELECT l.*, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(q.steps, []) AS steps
  FROM l JOIN s ON s.g = l.g LEFT JOIN q ON q.g = l.g AND q.i = l.i
),
r AS (
  SELECT *, list_reduce(list_prepend(CASE WHEN extra = '' THEN leaf ELSE extra END, steps), lambda a, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || a) WHEN 'R' THEN sha256(a || b[2:]) ELSE sha256(a) END) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
"""

OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p WHERE strlen(body) >= {warc.LEAST} GROUP BY body)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON g.body = p.body
"""

OP13_SQL = f"""
WITH {_TAB},
m AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS pos FROM m),
n AS (SELECT c, max(pos) AS n FROM o GROUP BY c),
h AS (SELECT c, c - c % 5 AS base, {_crc_sql('c')} % 9 AS h FROM n, tab),
w AS (
  SELECT h.c, pos AS place, role, text FROM h JOIN o ON o.c = h.base AND pos <= h
  UNION ALL SELECT h.c, 1000 + pos, role, text FROM h JOIN o ON o.c = h.c AND pos > h
),
v AS (SELECT h.c, list({{'r': role, 't': text}} ORDER BY place) FILTER (place IS NOT NULL) AS turns FROM h LEFT JOIN w ON w.c = h.c GROUP BY h.c),
x AS (SELECT c, coalesce(len(turns), 0) AS size, turns, unnest(generate_series(0, coalesce(len(turns), 0))) AS d FROM v),
y AS (SELECT c, d, size = d AS ends, CAST(to_json(turns[1:d]) AS VARCHAR) AS k, CAST(to_json(turns[1:d - 1]) AS VARCHAR) AS up, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].t) END AS tokens FROM x),
z AS (
  SELECT d, CASE WHEN d = 0 THEN '' ELSE k END AS k, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN any_value(up) END AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(tokens) AS saved, any_value(tokens) AS tokens,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, bool_and(ends) AS childless
  FROM y GROUP BY d, 2
),
a AS (SELECT y.c, y.d, CASE WHEN y.d = 0 THEN '' ELSE y.k END AS k FROM y),
s AS (
  SELECT u.d, u.k, sum(e.saved) AS saved_tokens, count(*) FILTER (e.childless) AS n_leaves
  FROM z e JOIN a o ON o.c = e.conv_id AND o.d <= e.d JOIN z u ON u.d = o.d AND u.k = o.k GROUP BY u.d, u.k
),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM z WHERE d > 0 GROUP BY ALL)
SELECT z.conv_id, CAST(z.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, z.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, z.ends_sha256
FROM z JOIN s USING (d, k) LEFT JOIN c USING (d, k) LEFT JOIN z p ON p.d = z.d - 1 AND p.k = z.up
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_merkle": op11_merkle, "op12_warc": op12_warc, "op13_prefix_trie": op13_prefix_trie}
SQL: dict[str, str] = {"op11_merkle": OP11_SQL, "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
