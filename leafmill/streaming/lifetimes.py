"""Keyed state that ends: sessions, jobs, daily quotas and entitlements, by timers of the state store.

Every processor takes one key's new rows in order of time and leaves nothing behind that has had its time: timers of event time
fire when the watermark has passed them, so a run over the same rows gives the same rows, whatever its micro-batches.  A session's clock
may be the wall's instead; its state then also has a time to live, so that a key goes even where its timer is lost.

Times are microseconds of UTC, timers the next whole millisecond; ``run_state`` sets what the state store needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState

DAY = 86_400_000_000
#: Fixed values, in microseconds: a session's and a job's lifetime, how often jobs are swept; and the daily limit.
SESSION, JOB, SWEEP, LIMIT = 30 * DAY, 600_000_000, 300_000_000, 3
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_state(spark: SparkSession) -> None:
    """Timers and state of several variables need the RocksDB store; the session is set to it unless it names another one."""
    if not spark.conf.get(_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKS)


def _day(at: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=at // DAY)).isoformat()


def _ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at, r.seq))


def _keep(value: ValueState, was: tuple | None, now: tuple | None) -> None:
    """A key's state after its rows, written once and only if it has changed."""
    if now is None and was is not None:
        value.clear()
    elif now != was:
        value.update(now)


class _Processor(StatefulProcessor):
    """One key's state; timers that were set are known to the store, whose handle is kept here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def at(self, time: int) -> None:
        self.handle.registerTimer(-(-time // 1000))

    def not_at(self, time: int) -> None:
        self.handle.deleteTimer(-(-time // 1000))

    def close(self) -> None:
        pass


class Sessions(_Processor):
    """A session lives a fixed time from its creation and no use extends it; it ends by its timer, by a use after its time, or by a sign-out.

    Rows of kind ``create`` begin one (and replace a live one), ``delete`` ends it, all others use it.
    """

    def __init__(self, lifetime: int = SESSION, ttl: int | None = None) -> None:
        self.lifetime, self.ttl = lifetime, ttl

    def open(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("created", T.LongType()), T.StructField("expires", T.LongType())])
        self.live = handle.getValueState("session", schema, self.ttl) if self.ttl else handle.getValueState("session", schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = held = tuple(self.live.get()) if self.live.exists() else None
        for r in _ordered(rows):
            if held and held[1] <= r.at:
                yield Row(key=key[0], seq=None, outcome="expired", at=held[1])
                self.not_at(held[1])
                held = None
            if r.kind == "create":
                if held:
                    yield Row(key=key[0], seq=r.seq, outcome="replaced", at=r.at)
                    self.not_at(held[1])
                held = (r.at, r.at + self.lifetime)
                self.at(held[1])
                yield Row(key=key[0], seq=r.seq, outcome="created", at=r.at)
            elif not held:
                yield Row(key=key[0], seq=r.seq, outcome="denied", at=r.at)
            elif r.kind == "delete":
                yield Row(key=key[0], seq=r.seq, outcome="deleted", at=r.at)
                self.not_at(held[1])
                held = None
            else:
                yield Row(key=key[0], seq=r.seq, outcome="allowed", at=r.at)
        _keep(self.live, was, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.live.exists():
            expires = self.live.get()[1]
            if expires <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.live.clear()
                yield Row(key=key[0], seq=None, outcome="expired", at=expires)


class Jobs(_Processor):
    """A job is processing until it has completed or failed; what its state doesn't allow is rejected; it is forgotten at the first sweep after its lifetime.

    Kinds: ``start``, ``progress`` (which may not go back), ``complete``, ``fail``.  Sweeps fall on multiples of their interval.
    """

    def __init__(self, lifetime: int = JOB, sweep: int = SWEEP) -> None:
        self.lifetime, self.sweep = lifetime, sweep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", T.StructType([T.StructField("status", T.StringType()), T.StructField("progress", T.DoubleType()), T.StructField("swept", T.LongType())]))

    def _out(self, key: tuple, r: Row | None, before: str | None, state: tuple, reason: str | None, at: int) -> Row:
        return Row(key=key[0], seq=r.seq if r else None, before=before, status=state[0], progress=float(state[1]), reason=reason, at=at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = held = tuple(self.job.get()) if self.job.exists() else None
        for r in _ordered(rows):
            if held and held[2] <= r.at:  # its sweep has come since
                yield self._out(key, None, held[0], ("swept", held[1]), None, held[2])
                self.not_at(held[2])
                held = None
            before = held[0] if held else None
            reason, new = None, held
            if r.kind == "start":
                if held:
                    reason = "already started"
                else:
                    swept = ((r.at + self.lifetime) // self.sweep + 1) * self.sweep
                    new = ("processing", 0.0, swept)
                    self.at(swept)
            elif not held:
                reason = "unknown job"
            elif before != "processing":
                reason = f"already {before}"
            elif r.kind == "progress":
                value = float(r.value) if r.value is not None else held[1]
                if value < held[1]:
                    reason = "progress goes back"
                else:
                    new = (before, value, held[2])
            else:
                new = ("completed", 100.0, held[2]) if r.kind == "complete" else ("failed", held[1], held[2])
            if reason is None:
                held = new
            yield self._out(key, r, before, held or ("none", 0.0), reason, r.at)
        _keep(self.job, was, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            held = tuple(self.job.get())
            if held[2] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.job.clear()
                yield self._out(key, None, held[0], ("swept", held[1]), None, held[2])


class Quota(_Processor):
    """Uses of a key's UTC days; a day's count goes when the watermark has passed its end, and no use can come late after that."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit = limit

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", T.StructType([T.StructField("day", T.LongType())]), T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used: dict[tuple, int] = {}  # each call to the store is a round trip, so a day is read and written once
        for r in _ordered(rows):
            day = (r.at // DAY,)
            if day not in used:
                known = self.days.containsKey(day)
                used[day] = self.days.getValue(day)[0] if known else 0
                if not known:
                    self.at((day[0] + 1) * DAY)
            n = used[day] = used[day] + 1
            yield Row(key=key[0], seq=r.seq, day=_day(r.at), n=n, consume_allowed=n < self.limit, checked_allowed=n <= self.limit)
        for day, n in used.items():
            self.days.updateValue(day, (n,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.days.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // DAY - 1,))
        return iter(())


class Entitlements(_Processor):
    """A key's record, folded as in batch; ids of events that were counted are forgotten ``remember`` after they came.

    The record itself is an account and stays.
    """

    def __init__(self, days: int = 30, remember: int = 60 * DAY) -> None:
        self.days, self.remember = days, remember

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", T.StructType([T.StructField("passes", T.IntegerType()), T.StructField("expires", T.LongType()), T.StructField("plan", T.StringType())]))
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("id", T.StringType())]), T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.record.get()) if self.record.exists() else None
        timers = set()
        for r in _ordered(rows):
            name = (r.event_id,)
            if r.kind in ("one_time", "monthly", "ended") and r.event_id is not None and self.seen.containsKey(name):
                continue
            passes, expires, plan = state or (0, None, None)
            later = r.expires if r.expires is not None else r.at + self.days * DAY
            if r.kind == "one_time":
                state = (passes + 1, expires, "one_time")
            elif r.kind == "admin_one_time":
                state = (max(1, r.passes if r.passes is not None else 1), expires, "one_time")
            elif r.kind in ("monthly", "admin_monthly"):
                state = (passes, later, "monthly")
            elif r.kind == "admin_revoke":
                state = (0, None, "unknown")
            elif state and r.kind == "ended":
                state = (passes, r.at, "unknown" if plan == "monthly" else plan)
            elif state and r.kind == "use":
                if passes > 0 and not (expires is not None and expires > r.at):
                    state = (passes - 1, expires, plan)
                continue
            else:
                continue
            if r.event_id is not None:
                self.seen.updateValue(name, (r.at,))
                timers.add(((r.at + self.remember) // DAY + 1) * DAY)
        for time in timers:
            self.at(time)
        if state:
            self.record.update(state)
            yield Row(key=key[0], passes=state[0], expires=state[1], plan=state[2])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.remember
        for name in [k for k, v in self.seen.iterator() if v[0] < end]:
            self.seen.removeKey(tuple(name))
        return iter(())


def _keyed(events: DataFrame, key: str, at: str, seq: str, late: str, more: dict) -> DataFrame:
    """Rows ``(key, seq, at, ...)`` with times in microseconds, their watermark ``late`` behind."""
    run_state(events.sparkSession)
    rows = events.withWatermark(at, late) if at in events.columns else events
    return rows.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.unix_micros(at).alias("at"), F.col(at).alias("event_time"), *(c.alias(n) for n, c in more.items()))


def _applied(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "Append", clock: str = "EventTime") -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").transformWithState(processor, schema.format(key=kinds["key"], seq=kinds["seq"]), mode, clock)


def sessions(events: DataFrame, key: str, at: str, seq: str, kind: str, late: str = "1 hour", lifetime: int = SESSION, wall_clock: bool = False) -> DataFrame:
    """What becomes of each row, and the end of each session: rows ``(key, seq, outcome, at)``; ``seq`` is null where a session expired by itself.

    With ``wall_clock`` timers are of processing time and rows are dated when they come; the state's time to live is an hour more than the lifetime.
    Such a query has no end of its own: start it with a trigger of processing time.
    """
    if wall_clock:
        run_state(events.sparkSession)
        rows = events.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.unix_micros(F.current_timestamp()).alias("at"), F.col(kind).alias("kind"))
        out = _applied(rows, Sessions(lifetime, lifetime // 1000 + 3_600_000), "key {key}, seq {seq}, outcome string, at long", clock="ProcessingTime")
    else:
        out = _applied(_keyed(events, key, at, seq, late, {"kind": F.col(kind)}), Sessions(lifetime), "key {key}, seq {seq}, outcome string, at long")
    return out.select(F.col("key").alias(key), F.col("seq").alias(seq), "outcome", F.timestamp_micros("at").alias("at"))


def jobs(events: DataFrame, key: str, at: str, seq: str, kind: str, value: str, late: str = "1 hour", lifetime: int = JOB, sweep: int = SWEEP) -> DataFrame:
    """Transitions of each job: rows ``(key, seq, before, status, progress, reason, at)``; ``reason`` tells why a row was rejected, ``seq`` is null for sweeps."""
    rows = _keyed(events, key, at, seq, late, {"kind": F.col(kind), "value": F.col(value).cast("double")})
    out = _applied(rows, Jobs(lifetime, sweep), "key {key}, seq {seq}, before string, status string, progress double, reason string, at long")
    return out.select(F.col("key").alias(key), F.col("seq").alias(seq), "before", "status", "progress", "reason", F.timestamp_micros("at").alias("at"))


def quota(events: DataFrame, key: str, at: str, seq: str, late: str = "1 hour", limit: int = LIMIT) -> DataFrame:
    """Each use with its number in the key's UTC day; uses later than the watermark are dropped, so that no day is counted twice."""
    out = _applied(_keyed(events, key, at, seq, late, {}), Quota(limit), "key {key}, seq {seq}, day string, n long, consume_allowed boolean, checked_allowed boolean")
    return out.withColumnsRenamed({"key": key, "seq": seq})


def entitlements(events: DataFrame, key: str, late: str = "1 hour", days: int = 30, remember: int = 60 * DAY) -> DataFrame:
    """Each key's record after its events so far: ``passes, expires_at, plan``; input and kinds as for the batch fold, ordered by ``at``, then ``seq``, in a micro-batch."""
    have = set(events.columns)
    opt = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    more = {"kind": F.col("kind"), "event_id": opt("event_id", "string"), "expires": F.unix_micros(opt("expires_at", "timestamp")), "passes": opt("passes", "int")}
    out = _applied(_keyed(events, key, "at", "seq", late, more), Entitlements(days, remember), "key {key}, passes int, expires long, plan string", "Update")
    return out.select(F.col("key").alias(key), "passes", F.timestamp_micros("expires").alias("expires_at"), "plan")
