"""Queries that run as streams over all events, which come in parts; each part resumes the query from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.plans import accounts
from leafmill.sources import versioned
from leafmill.sources.scratch import scratch_path
from leafmill.sources.tables import table
from leafmill.streaming import accounts as S
from leafmill.streaming import lifetimes as L

#: Parts that a query's input comes in.
PARTS = 4
HOUR = 3_600_000_000
#: Lifetimes of the analogues, in microseconds: users' events are hours apart.
SESSION, JOB, SWEEP, LATE = 24 * HOUR, 12 * HOUR, 4 * HOUR, HOUR


def _parts(events: DataFrame) -> list[DataFrame]:
    """The events in ``PARTS`` spans of time, the earliest first; an empty table is one part."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [events]
    ends = [first + (last - first) / PARTS * i for i in range(1, PARTS)]
    spans = zip([None, *ends], [*ends, None])
    return [events.where((F.col("ts") >= F.lit(a) if a else F.lit(True)) & (F.col("ts") < F.lit(b) if b else F.lit(True))) for a, b in spans]


def run(spark: SparkSession, parts: list[DataFrame], query: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All rows that ``query`` makes of a stream of the parts, with ``batch``.

    A part is written by as many tasks as it has, then the query is started, takes what is new and stops; state passes from part to part
    by the checkpoint alone.  A batch that is run again replaces its own files.
    """
    base, inputs = scratch_path(spark, "stream"), scratch_path(spark, "events")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    for part in parts:
        part.write.mode("append").parquet(inputs)
        stream = query(spark.readStream.schema(part.schema).parquet(inputs))
        started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")


def _events(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return _parts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))).where("_n = 1").drop("_n", "batch")


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run(spark, _events(spark, sf_dir), lambda e: L.quota(e, "user_id", "ts", "event_id"), "append")
    return out.select("event_id", "user_id", "day", "n", "consume_allowed", "checked_allowed")


def stream_daily_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _latest(run(spark, _events(spark, sf_dir), lambda e: S.daily_uses(e, "user_id", "ts"), "update"), ["user_id", "day"])
    return out.select("user_id", F.col("day").cast("string").alias("day"), F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"))


def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery keys, each once."""
    return run(spark, _events(spark, sf_dir), lambda e: S.first_deliveries(e, "props", "ts", "60 days"), "append").select("props")


def stream_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run(spark, _events(spark, sf_dir), lambda e: L.entitlements(accounts.grants(e), "user_id"), "update")
    return _latest(out, ["user_id"])


def stream_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: records that operators grant and revoke too: views set two passes, logouts clear all."""

    def granted(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", "one_time").when(F.col("event_type") == "signup", "use").when(F.col("event_type") == "click", "admin_one_time").when(F.col("event_type") == "error", "admin_revoke")
        rows = e.select("user_id", F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.col("event_id").cast("string").alias("event_id"), F.lit(2).alias("passes"))
        return L.entitlements(rows.where("kind is not null"), "user_id")

    return _latest(run(spark, _events(spark, sf_dir), granted, "update"), ["user_id"]).select("user_id", "passes", "plan")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: signups begin a user's session of a day, errors end it, other events use it."""

    def lived(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("use")
        return L.sessions(e.withColumn("kind", kind), "user_id", "ts", "event_id", "kind", f"{LATE} microseconds", SESSION)

    return run(spark, _events(spark, sf_dir), lived, "append").select("user_id", "event_id", "outcome", "at")


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: a user has one job at a time; signups start it, views and clicks report progress, purchases complete it and errors fail it."""

    def moved(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("progress")
        return L.jobs(e.withColumn("kind", kind), "user_id", "ts", "event_id", "kind", "value", f"{LATE} microseconds", JOB, SWEEP)

    return run(spark, _events(spark, sf_dir), moved, "append").select("user_id", "event_id", "before", "status", "progress", "reason", "at")


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogue: each user's last event as a record of a store that a stream keeps up to date; an error removes the record."""
    base, inputs = scratch_path(spark, "store"), scratch_path(spark, "events")
    for part in _events(spark, sf_dir):
        part.write.mode("append").parquet(inputs)
        stream = spark.readStream.schema(part.schema).parquet(inputs)
        rows = stream.select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
        versioned.upserts(rows, f"{base}/records", "user_id", "event_id", "gone").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return versioned.read_store(spark, f"{base}/records", "user_id bigint, event_id bigint, event_type string, value double")


_ROWS = f"""WITH RECURSIVE m AS (SELECT (epoch_us(max(ts)) - {LATE}) // 1000 * 1000 AS mark FROM events),
e AS (SELECT user_id, event_id, event_type AS k, value AS v, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),"""
#: ``ex``: the end of the session that is live after the row, ``was``: of that which was live before it.
_SESSIONS = f"""{_ROWS}
f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS ex, CAST(NULL AS BIGINT) AS was FROM e
  UNION ALL
  SELECT e.user_id, e.n, e.event_id,
    CASE WHEN k = 'signup' THEN 'created' WHEN ex IS NULL OR ex <= e.t THEN 'denied' WHEN k = 'error' THEN 'deleted' ELSE 'allowed' END, e.t,
    CASE WHEN k = 'signup' THEN e.t + {SESSION} WHEN ex IS NULL OR ex <= e.t OR k = 'error' THEN NULL ELSE ex END, ex
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1
),
x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS next FROM f)
SELECT user_id, event_id, outcome, make_timestamp(t) AS at FROM f WHERE n > 0
UNION ALL SELECT user_id, event_id, 'replaced', make_timestamp(t) FROM f WHERE outcome = 'created' AND was > t
UNION ALL SELECT user_id, NULL, 'expired', make_timestamp(ex) FROM x, m WHERE ex <= coalesce(next, mark)"""
_JOBS = f"""{_ROWS}
f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS status, CAST(0 AS DOUBLE) AS progress, CAST(NULL AS BIGINT) AS swept, CAST(NULL AS VARCHAR) AS reason FROM e
  UNION ALL
  SELECT user_id, n, event_id, t, before,
    CASE WHEN reason IS NOT NULL THEN before WHEN k = 'signup' THEN 'processing' WHEN k = 'purchase' THEN 'completed' WHEN k = 'error' THEN 'failed' ELSE before END,
    CASE WHEN reason IS NOT NULL THEN progress WHEN k = 'signup' THEN 0 WHEN k = 'purchase' THEN 100 WHEN k = 'error' THEN progress ELSE coalesce(v, progress) END,
    CASE WHEN reason IS NULL AND k = 'signup' THEN ((t + {JOB}) // {SWEEP} + 1) * {SWEEP} ELSE swept END, reason
  FROM (
    SELECT *, CASE WHEN k = 'signup' THEN CASE WHEN before IS NOT NULL THEN 'already started' END WHEN before IS NULL THEN 'unknown job' WHEN before <> 'processing' THEN 'already ' || before
      WHEN k IN ('view', 'click') AND v < progress THEN 'progress goes back' END AS reason
    FROM (
      SELECT e.user_id, e.n, e.event_id, e.t, e.k, e.v, CASE WHEN swept > e.t THEN status END AS before, CASE WHEN swept > e.t THEN progress ELSE 0 END AS progress, CASE WHEN swept > e.t THEN swept END AS swept
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1
    )
  )
),
x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS next FROM f)
SELECT user_id, event_id, before, coalesce(status, 'none') AS status, progress, reason, make_timestamp(t) AS at FROM f WHERE n > 0
UNION ALL SELECT user_id, NULL, status, 'swept', progress, NULL, make_timestamp(swept) FROM x, m WHERE swept <= coalesce(next, mark)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_quota, stream_daily_uses, stream_deliveries, stream_entitlements, stream_admin, stream_sessions, stream_jobs, stream_store)}
SQL = {
    "stream_store": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'",
    "stream_sessions": _SESSIONS,
    "stream_jobs": _JOBS,
    "stream_quota": "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, n, n < 3 AS consume_allowed, n <= 3 AS checked_allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)",
    "stream_daily_uses": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, least(count(*), 3) AS used, greatest(0, 3 - count(*)) AS remaining FROM events GROUP BY 1, 2",
    "stream_admin": """WITH RECURSIVE e AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'click', 'error')),
      f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, false AS known, 0 AS passes, CAST(NULL AS VARCHAR) AS plan FROM e UNION ALL
        SELECT f.user_id, e.n, known OR k <> 'signup', CASE k WHEN 'purchase' THEN passes + 1 WHEN 'click' THEN 2 WHEN 'error' THEN 0 ELSE passes - CASE WHEN known AND passes > 0 THEN 1 ELSE 0 END END,
          CASE k WHEN 'signup' THEN plan WHEN 'error' THEN 'unknown' ELSE 'one_time' END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
      SELECT user_id, passes, plan FROM f WHERE known QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "stream_deliveries": "SELECT DISTINCT props FROM events",
    "stream_entitlements": f"SELECT user_id, stored_passes AS passes, ex AS expires_at, stored_plan AS plan FROM ({accounts._FOLD.format(now=accounts.NOW).rstrip().replace('plan AS stored_plan,', 'plan AS stored_plan, ex,')})",
}
