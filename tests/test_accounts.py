"""Entitlement folds, and streams against their batch forms."""

from pyspark.sql import functions as F

from leafmill.operators import accounts as A
from leafmill.streaming import accounts as S
from leafmill.streaming import lifetimes as L

DDL = "user_id int, seq bigint, at timestamp, kind string, event_id string, passes int"


def events(spark, rows):
    return spark.createDataFrame([(u, i, None, k, e, p) for i, (u, k, e, p) in enumerate(rows)], DDL).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60))


def records(spark, rows):
    return {r.user_id: (r.passes, r.plan) for r in A.entitlements(events(spark, rows), "user_id").collect()}


def test_fold(spark):
    assert records(spark, [(1, "one_time", "e1", None), (1, "one_time", "e1", None)]) == {1: (1, "one_time")}
    assert records(spark, [(1, "admin_one_time", None, 2), (1, "admin_one_time", None, 2)]) == {1: (2, "one_time")}
    assert records(spark, [(1, "ended", "e", None), (2, "other", "x", None)]) == {}
    assert records(spark, [(1, "one_time", "a", None), (1, "monthly", "b", None), (1, "use", None, None), (1, "ended", "c", None), (1, "use", None, None)]) == {1: (0, "unknown")}
    assert records(spark, [(1, "one_time", "a", None), (1, "admin_revoke", None, None)]) == {1: (0, "unknown")}


def test_settings_and_products(spark):
    df = spark.createDataFrame([("p1",), ("p9",), (None,)], "p string")
    assert [r[0] for r in df.select(A.granted(F.col("p"), ["p1"], [])).collect()] == ["monthly", None, None]


def test_late_days_keep_their_counts(spark, tmp_path):
    at = ["2024-01-01 10:00", "2024-01-02 10:00", "2024-01-01 23:00", "2024-01-02 11:00"]
    src = str(tmp_path / "late")
    schema = "user_id int, at timestamp, seq int"
    for i, t in enumerate(at):  # one file and one micro-batch each
        spark.createDataFrame([(1, i)], "user_id int, seq int").select("user_id", F.lit(t).cast("timestamp").alias("at"), "seq").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = L.quota(s, "user_id", "at", "seq", "2 days").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "late-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.seq, r.n) for r in spark.table("late").collect()} == {(0, 1), (1, 1), (2, 2), (3, 2)}


def test_quota_routes(spark):
    e = spark.createDataFrame([("k", i) for i in range(4)], "key string, seq int").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    got = A.daily_quota(e, "key", "at", "seq").orderBy("seq").collect()
    assert [r.consume_allowed for r in got] == [True, True, False, False]
    assert [r.checked_allowed for r in got] == [True, True, True, False]
    assert [r["count"] for r in got] == [1, 2, 3, 3]


def _streamed(spark, tmp_path, df, make, mode, name):
    src = str(tmp_path / name)
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(src)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_match_batch(spark, tmp_path):
    rows = [(u, k, f"{u}-{i}", None) for i, (u, k) in enumerate([(1, "one_time"), (2, "monthly"), (1, "use"), (2, "ended"), (3, "use"), (1, "one_time")])]
    df = events(spark, rows).drop("passes")
    got = _streamed(spark, tmp_path, df, lambda s: L.entitlements(s, "user_id"), "update", "fold")
    assert {r.user_id: (r.passes, r.plan) for r in got.collect()} == {r.user_id: (r.passes, r.plan) for r in A.entitlements(df, "user_id").collect()}

    uses = df.select("user_id", "at", "seq")
    got = _streamed(spark, tmp_path, uses, lambda s: L.quota(s, "user_id", "at", "seq"), "append", "quota")
    want = A.daily_quota(uses, "user_id", "at", "seq")
    assert {(r.seq, r.n, r.consume_allowed) for r in got.collect()} == {(r.seq, r.n, r.consume_allowed) for r in want.collect()}

    twice = uses.union(uses).withColumn("key", F.col("seq").cast("string"))
    assert _streamed(spark, tmp_path, twice, lambda s: S.first_deliveries(s, "key", "at"), "append", "once").count() == uses.count()
    assert _streamed(spark, tmp_path, uses, lambda s: S.daily_uses(s, "user_id", "at"), "update", "uses").count() == 3
