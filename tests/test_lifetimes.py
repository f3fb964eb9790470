"""Keyed state that ends: every query here is stopped and resumed from its checkpoint between parts."""

import time

from pyspark.sql import functions as F

from leafmill.plans import streams
from leafmill.streaming import lifetimes as L

KIND = "event_id long, user_id string, at string, kind string, value double"


def parts(spark, *spans):
    return [spark.createDataFrame(rows, KIND).withColumn("ts", F.col("at").cast("timestamp")).drop("at") for rows in spans]


def test_sessions_end_by_timer_use_and_sign_out(spark):
    spans = parts(
        spark,
        [(1, "a", "2024-01-01 00:00:00", "create", None), (2, "a", "2024-01-01 09:00:00", "use", None), (3, "b", "2024-01-01 10:00:00", "use", None), (4, "c", "2024-01-01 10:00:00", "create", None), (5, "d", "2024-01-01 10:00:00", "create", None)],
        [(6, "d", "2024-01-01 11:00:00", "create", None), (7, "c", "2024-01-01 20:00:00", "delete", None), (8, "c", "2024-01-01 20:00:00", "use", None)],
        [(9, "z", "2024-01-02 11:30:00", "use", None)],
    )
    out = streams.run(spark, spans, lambda e: L.sessions(e, "user_id", "ts", "event_id", "kind", "1 hour", L.DAY), "append").collect()
    got = {(r.user_id, r.event_id, r.outcome) for r in out}
    assert got == {
        ("a", 1, "created"), ("a", 2, "allowed"), ("a", None, "expired"), ("b", 3, "denied"), ("c", 4, "created"), ("c", 7, "deleted"), ("c", 8, "denied"),
        ("d", 5, "created"), ("d", 6, "replaced"), ("d", 6, "created"), ("z", 9, "denied"),
    }
    (end,) = [r for r in out if r.outcome == "expired"]  # no row of its own brought it about
    assert str(end["at"]) == "2024-01-02 00:00:00" and end.batch > 0


def test_jobs_reject_what_their_state_does_not_allow(spark):
    t = lambda m: f"2024-01-01 00:{m:02}:00"
    spans = parts(
        spark,
        [(1, "a", t(1), "progress", 5.0), (2, "a", t(2), "start", None), (3, "a", t(3), "progress", 20.0), (4, "a", t(4), "progress", 10.0), (5, "b", t(4), "start", None)],
        [(6, "a", t(5), "complete", None), (7, "a", t(6), "fail", None), (8, "a", t(6), "start", None), (9, "b", t(7), "fail", None)],
        [(10, "z", t(40), "start", None)],
    )
    out = streams.run(spark, spans, lambda e: L.jobs(e, "user_id", "ts", "event_id", "kind", "value", "1 minute"), "append").orderBy("event_id").collect()
    rows = [(r.event_id, r.before, r.status, r.progress, r.reason) for r in out if r.event_id]
    assert rows == [
        (1, None, "none", 0.0, "unknown job"), (2, None, "processing", 0.0, None), (3, "processing", "processing", 20.0, None), (4, "processing", "processing", 20.0, "progress goes back"), (5, None, "processing", 0.0, None),
        (6, "processing", "completed", 100.0, None), (7, "completed", "completed", 100.0, "already completed"), (8, "completed", "completed", 100.0, "already started"), (9, "processing", "failed", 0.0, None), (10, None, "processing", 0.0, None),
    ]
    # Ten minutes after their start, at the next sweep.
    assert sorted((r.user_id, r.before, str(r["at"])[11:]) for r in out if r.status == "swept") == [("a", "completed", "00:15:00"), ("b", "failed", "00:15:00")]


def test_late_uses_do_not_begin_a_day_anew(spark):
    use = lambda n, at: (n, "a", at, "use", None)
    spans = parts(spark, [use(1, "2024-01-01 23:00:00"), use(2, "2024-01-01 22:00:00")], [use(3, "2024-01-03 00:00:00")], [use(4, "2024-01-01 23:30:00"), use(5, "2024-01-03 01:00:00")])
    out = streams.run(spark, spans, lambda e: L.quota(e, "user_id", "ts", "event_id", "1 hour"), "append").collect()
    assert {(r.event_id, r.day, r.n) for r in out} == {(2, "2024-01-01", 1), (1, "2024-01-01", 2), (3, "2024-01-03", 1), (5, "2024-01-03", 2)}


def test_counted_ids_are_forgotten_in_time(spark):
    def rows(*items):
        return spark.createDataFrame(items, "seq long, user_id string, event_id string, ts string").select("seq", "user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), F.lit("one_time").alias("kind"))

    spans = [rows((1, "a", "x", "2024-01-01 00:00:00"), (2, "a", "x", "2024-01-01 01:00:00")), rows((3, "a", "x", "2024-01-02 00:00:00")), rows((4, "z", "y", "2024-01-09 00:00:00")), rows((5, "a", "x", "2024-01-09 01:00:00"))]
    out = streams.run(spark, spans, lambda e: L.entitlements(e, "user_id", remember=3 * L.DAY), "update")
    assert [r.passes for r in out.where("user_id = 'a'").orderBy("batch").collect()] == [1, 1, 2]


def test_wall_clock_sessions_expire_by_themselves(spark, tmp_path):
    parts(spark, [(1, "a", "2024-01-01 00:00:00", "create", None)])[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id string, kind string, value double, ts timestamp").parquet(str(tmp_path / "in"))
    out = L.sessions(stream, "user_id", "ts", "event_id", "kind", lifetime=1_000_000, wall_clock=True)
    query = out.writeStream.format("memory").queryName("wall").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):  # no more rows come: the timer alone ends the session
            time.sleep(1)
            got = [r.outcome for r in spark.table("wall").collect()]
            if "expired" in got:
                break
    finally:
        query.stop()
    assert got == ["created", "expired"]


def test_streams_over_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_sessions", "stream_jobs", "stream_quota"):
        assert streams.QUERIES[name](spark, str(tmp_path)).collect() == []
