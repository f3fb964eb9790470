"""Queries on accounts, entitlements and usage; star-schema tables stand in for the stores where noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import accounts as A
from leafmill.sources.tables import table

NOW = "2024-02-01 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def usage_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one use of its user's daily quota."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return A.daily_quota(e, "user_id", "ts", "event_id").select("event_id", "user_id", F.col("day").cast("string").alias("day"), "n", "count", "consume_allowed", "checked_allowed")


def usage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_status(_events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts").withColumn("day", F.col("day").cast("string"))


def event_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties text stands in for a delivery key that comes again."""
    return A.first_deliveries(_events(spark, sf_dir).select("event_id", "props", "event_type", "ts"), "props", "ts", "event_id").select("props", "event_id", "event_type", "ts")


def webhook_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events wrapped as deliveries: type from the body, then routed, counted by outcome."""
    kinds = F.when(F.col("event_type") == "purchase", "order.paid").when(F.col("event_type") == "error", "subscription.revoked").when(F.col("event_type") == "click", "subscription.updated").otherwise(F.col("event_type"))
    key = F.when(F.col("event_id") % 3 == 0, "type").when(F.col("event_id") % 3 == 1, "event").otherwise("event_type")
    body = _events(spark, sf_dir).select(F.concat(F.lit('{"'), key, F.lit('": "'), kinds, F.lit('"}')).alias("body"))
    routed = body.select(A.event_type(F.col("body")).alias("kind"))
    return routed.groupBy("kind", A.route(F.col("kind")).alias("outcome")).agg(F.count("*").alias("n"))


def grants(events: DataFrame) -> DataFrame:
    """Analogue: purchases under 20 grant a pass, others a month; errors end a subscription; signups use a pass."""
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") < 20), "one_time").when(F.col("event_type") == "purchase", "monthly").when(F.col("event_type") == "error", "ended").when(F.col("event_type") == "signup", "use")
    e = events.select(F.col("user_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.col("event_id").cast("string").alias("event_id"))
    return e.where("kind is not null")


def entitlement_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.entitlements(grants(_events(spark, sf_dir)), "user_id")
    s = A.status(r, F.lit(NOW).cast("timestamp"), [], "user_id")
    kept = r.select("user_id", F.col("passes").alias("stored_passes"), F.col("plan").alias("stored_plan"), F.size("seen").cast("long").alias("n_seen"))
    return s.join(kept, "user_id")


def account_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: orders are sessions of their customer, customers with a balance over 5000 are records."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    sessions = o.select(F.upper("c_name").alias("email"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    premium = c.where("c_acctbal > 5000").select(F.concat(F.lit(" "), F.col("c_name")).alias("email"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"), F.lit(True).alias("is_premium"), F.when(F.col("c_mktsegment") == "BUILDING", "monthly").otherwise("one_time").alias("plan"), (F.col("c_nationkey") % 5).cast("int").alias("passes"))
    return A.user_rollup(sessions, premium)


def account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(account_rollup(spark, sf_dir))


def account_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: customers whose name or segment has a text, by balance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return A.search_page(c, "BUIL", [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 20, 25, ("c_name", "c_mktsegment"))


def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_tail(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"), "event_id", 1000)


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.live_sessions(_events(spark, sf_dir).select("event_id", "ts"), "ts", F.lit("2024-02-10 12:00:00").cast("timestamp")).select("event_id", "expires_at")


def job_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: a user's events are a job's state changes."""
    return A.latest_status(_events(spark, sf_dir), "user_id", "event_id", ["event_type", "value", "ts"])


def job_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.swept(_events(spark, sf_dir).select("event_id", "ts"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def password_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: every customer's name and segment, cut and mixed by key, as a password; some are empty."""
    k = F.col("c_custkey")
    p = F.when(k % 7 == 0, "").when(k % 7 == 1, F.lower("c_mktsegment")).when(k % 7 == 2, F.col("c_mktsegment")).when(k % 7 == 3, F.concat(F.initcap("c_mktsegment"), k.cast("string"))).when(k % 7 == 4, F.regexp_replace("c_name", "#", "")).when(k % 7 == 5, F.col("c_name")).otherwise(k.cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", p.alias("p"))
    score, label = A.password_strength(F.col("p"))
    return c.select("c_custkey", "p", score.alias("score"), label.alias("label"))


def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: every supplier's request, some of which came by proxies."""
    k = F.col("s_suppkey")
    ip = F.concat(F.lit("10.0."), k.cast("string"))
    h = F.when(k % 4 == 0, F.concat(ip, F.lit(".1, 9.9.9.9"))).when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit("  "), ip, F.lit(".2 ")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", h.alias("h"), F.concat(ip, F.lit(".9")).alias("peer"))
    return s.select("s_suppkey", "h", "peer", A.client_key(F.col("h"), F.col("peer")).alias("client"))


_FOLD = """
WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, ts AS t, CASE WHEN event_type = 'purchase' AND value < 20 THEN 'one_time' WHEN event_type = 'purchase' THEN 'monthly' WHEN event_type = 'error' THEN 'ended'
   WHEN event_type = 'signup' THEN 'use' END AS kind FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM e WHERE kind IS NOT NULL),
f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, false AS known, 0 AS passes, CAST(NULL AS TIMESTAMP) AS ex, CAST(NULL AS VARCHAR) AS plan, CAST(0 AS BIGINT) AS seen FROM o
  UNION ALL
  SELECT f.user_id, o.n, f.known OR kind IN ('one_time', 'monthly'),
    CASE WHEN kind = 'one_time' THEN passes + 1 WHEN kind = 'use' AND known AND NOT coalesce(ex > o.t, false) AND passes > 0 THEN passes - 1 ELSE passes END,
    CASE WHEN kind = 'monthly' THEN o.t + INTERVAL 30 DAY WHEN kind = 'ended' AND known THEN o.t ELSE ex END,
    CASE WHEN kind IN ('monthly', 'one_time') THEN kind WHEN kind = 'ended' AND known AND plan = 'monthly' THEN 'unknown' ELSE plan END,
    seen + CASE WHEN kind IN ('one_time', 'monthly') OR (kind = 'ended' AND known) THEN 1 ELSE 0 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1
),
l AS (SELECT * FROM f WHERE known QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, coalesce(ex > TIMESTAMP '{now}', false) OR passes > 0 AS is_premium,
  CASE WHEN coalesce(ex > TIMESTAMP '{now}', false) THEN 'monthly' WHEN passes > 0 THEN 'one_time' ELSE plan END AS plan,
  CASE WHEN ex > TIMESTAMP '{now}' THEN ex END AS expires_at, passes, passes AS stored_passes, plan AS stored_plan, seen AS n_seen FROM l
"""
_USERS = """WITH s AS (SELECT lower(trim(c_name)) AS email, count(*) AS session_count, arg_min(o_orderpriority, o_orderkey) AS name, max(o_orderdate) AS seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT lower(trim(c_name)) AS email, true AS is_premium, CASE WHEN c_mktsegment = 'BUILDING' THEN 'monthly' ELSE 'one_time' END AS plan, CAST(c_nationkey % 5 AS INT) AS passes, TIMESTAMP '2024-01-01' AS rec FROM customer WHERE c_acctbal > 5000),
u AS (SELECT email, name, coalesce(session_count, 0) AS session_count, coalesce(is_premium, false) AS is_premium, plan, coalesce(passes, 0) AS passes, coalesce(rec, seen) AS updated_at FROM s FULL JOIN p USING (email))"""

QUERIES = {
    f.__name__: f
    for f in (usage_daily_quota, usage_status, event_dedupe_first, webhook_routing, entitlement_fold, account_rollup, account_summary, account_search_page, audit_tail, session_ttl, job_latest_status, job_sweep, password_strength, client_key)
}
SQL = {
    "usage_daily_quota": "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, n, least(n, 3) AS count, n < 3 AS consume_allowed, n <= 3 AS checked_allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)",
    "usage_status": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, least(count(*), 3) AS used, greatest(0, 3 - count(*)) AS remaining, count(*) < 3 AS allowed FROM events GROUP BY 1, 2",
    "event_dedupe_first": "SELECT props, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1",
    "webhook_routing": "SELECT kind, CASE WHEN kind = 'order.paid' THEN 'grant' WHEN kind = 'subscription.revoked' THEN 'cancel' WHEN kind = 'subscription.updated' THEN 'lifecycle' ELSE 'ignored' END AS outcome, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'order.paid' WHEN 'error' THEN 'subscription.revoked' WHEN 'click' THEN 'subscription.updated' ELSE event_type END AS kind FROM events) GROUP BY 1, 2",
    "entitlement_fold": _FOLD.format(now=NOW),
    "account_rollup": _USERS + " SELECT * FROM u",
    "account_summary": _USERS + " SELECT count(*) AS users, count(*) FILTER (is_premium) AS premium_users, count(*) FILTER (plan = 'monthly') AS monthly_users, CAST(sum(passes) AS BIGINT) AS passes FROM u",
    "account_search_page": "WITH f AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE contains(lower(c_name), 'buil') OR contains(lower(c_mktsegment), 'buil')) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 20",
    "audit_tail": "SELECT event_id, user_id, event_type, ts FROM events ORDER BY event_id DESC LIMIT 200",
    "session_ttl": "SELECT event_id, ts + INTERVAL 30 DAY AS expires_at FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-10 12:00:00'",
    "job_latest_status": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts FROM events GROUP BY 1",
    "job_sweep": "SELECT count(*) AS n, max(event_id) AS last_id FROM events WHERE ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-15'",
    "password_strength": """SELECT c_custkey, p, score, CASE WHEN len(p) = 0 THEN '입력 전' WHEN score <= 2 THEN '약함' WHEN score <= 4 THEN '보통' ELSE '강함' END AS label FROM (SELECT c_custkey, p, CAST(len(p) >= 8 AS INT) + CAST(len(p) >= 12 AS INT)
      + CAST(regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]') AS INT) + CAST(regexp_matches(p, '[0-9]') AS INT) + CAST(regexp_matches(p, '[^A-Za-z0-9]') AS INT) AS score FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment WHEN 3 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || c_custkey
        WHEN 4 THEN replace(c_name, '#', '') WHEN 5 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS p FROM customer))""",
    "client_key": """SELECT s_suppkey, h, peer, coalesce(nullif(trim(split_part(h, ',', 1)), ''), peer) AS client FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '10.0.' || s_suppkey || '.1, 9.9.9.9' WHEN 1 THEN '' WHEN 2 THEN '  10.0.' || s_suppkey || '.2 ' END AS h, '10.0.' || s_suppkey || '.9' AS peer FROM supplier)""",
}
