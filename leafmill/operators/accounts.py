"""Accounts, entitlements, usage and audit views.

The current time is a parameter everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAILY_LIMIT = 3


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarded header, else the peer's."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)


def is_email(value: Column) -> Column:
    return value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def event_type(body: Column) -> Column:
    """The type of an event's JSON: ``type``, ``event`` or ``event_type``, the first that is there."""
    return F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in ("type", "event", "event_type")), F.lit(""))


#: Event types by what they do.
GRANT = ("order.paid", "subscription.active", "subscription.renewed")
CANCEL = ("subscription.revoked",)
LIFECYCLE = ("subscription.canceled", "subscription.updated")


def route(kind: Column) -> Column:
    """What an event does: grant, cancel, lifecycle or ignored."""
    return F.when(kind.isin(*GRANT), "grant").when(kind.isin(*CANCEL), "cancel").when(kind.isin(*LIFECYCLE), "lifecycle").otherwise("ignored")


def granted(product: Column, monthly: list[str], one_time: list[str]) -> Column:
    """What a product grants: ``monthly``, ``one_time``, or null for products that aren't on either list."""
    known = lambda ids: product.isin(*ids) if ids else F.lit(False)
    return F.when(known(monthly), "monthly").when(known(one_time), "one_time")


def is_uuid(value: Column) -> Column:
    return F.trim(value).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_placeholder(value: Column, examples: tuple[str, ...] = ()) -> Column:
    """Whether a setting is empty, an example, the zero UUID, or text that says to replace it."""
    v = F.trim(value)
    return (v == "") | v.isin(*examples, "00000000-0000-0000-0000-000000000000") | v.rlike("(?i)x{6,}") | v.contains("your-") | v.contains("replace-with-")


def daily_quota(uses: DataFrame, key: str, at: str, seq: str, limit: int = DAILY_LIMIT) -> DataFrame:
    """Each use with its UTC ``day``, its number ``n`` in the key's day, and the outcomes of both routes.

    ``count`` is what is stored after the use; ``consume_allowed`` is computed after the increment, so the
    last use within the limit already reads false; ``checked_allowed`` is tested before it.
    """
    day = F.to_date(at)
    n = F.row_number().over(W.partitionBy(key, day).orderBy(at, seq)).cast("long")
    return uses.withColumns({"day": day, "n": n}).withColumns({"count": F.least("n", F.lit(limit).cast("long")), "consume_allowed": F.col("n") < limit, "checked_allowed": F.col("n") <= limit})


def usage_status(uses: DataFrame, key: str, at: str, limit: int = DAILY_LIMIT) -> DataFrame:
    """Per key and UTC day: uses counted up to the limit, what remains, and whether another is allowed."""
    c = uses.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return c.select(key, "day", F.least("n", F.lit(limit)).cast("long").alias("used"), F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"), (F.col("n") < limit).alias("allowed"))


def first_deliveries(events: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The first event of each delivery key; a partial minimum, so a key delivered again and again is reduced before the shuffle."""
    rest = [c for c in events.columns if c not in (key, at, seq)]
    got = events.groupBy(key).agg(F.min(F.struct(at, seq, *rest)).alias("e"))
    return got.select(key, "e.*")


def entitlements(events: DataFrame, key: str = "email", days: int = 30) -> DataFrame:
    """The records that an ordered fold of each key's events leaves.

    ``events`` has ``key``, ``seq``, ``at`` (timestamp), ``kind`` and optionally ``event_id``, ``expires_at`` and ``passes``. Kinds:
    ``one_time`` (+1 pass), ``monthly`` (expiry as given or ``days`` from now), ``ended`` (expiry now, monthly becomes unknown; only
    for known records), ``admin_one_time`` (sets passes to max(1, passes)), ``admin_monthly``, ``admin_revoke`` (clears all) and ``use`` (one pass
    less, unless a subscription is active). An event id that the record holds already does nothing.
    """
    have = set(events.columns)
    opt = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    one = F.struct("seq", "at", "kind", opt("event_id", "string"), opt("expires_at", "timestamp"), opt("passes", "int"))
    folded = events.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("events"))  # one account's history is one state
    state = "struct<known:boolean,passes:int,expires_at:timestamp,plan:string,seen:array<string>,updated_at:timestamp>"
    start = F.from_json(F.lit('{"known":false,"passes":0,"seen":[]}'), state)
    later = lambda e: e.at + F.make_interval(days=F.lit(days))

    def step(s: Column, e: Column) -> Column:
        k = e.kind
        repeat = k.isin("one_time", "monthly", "ended") & e.event_id.isNotNull() & F.coalesce(F.array_contains(s.seen, e.event_id), F.lit(False))
        active = F.coalesce(s.expires_at > e.at, F.lit(False))
        skip = repeat | ((k == "ended") & ~s.known) | ((k == "use") & (~s.known | active | (s.passes <= 0))) | ~k.isin("one_time", "monthly", "ended", "admin_one_time", "admin_monthly", "admin_revoke", "use")
        passes = F.when(k == "one_time", s.passes + 1).when(k == "admin_one_time", F.greatest(F.lit(1), F.coalesce(e.passes, F.lit(1)))).when(k == "admin_revoke", 0).when(k == "use", s.passes - 1).otherwise(s.passes)
        expires = F.when(k.isin("monthly", "admin_monthly"), F.coalesce(e.expires_at, later(e))).when(k == "ended", e.at).when(k == "admin_revoke", F.lit(None).cast("timestamp")).otherwise(s.expires_at)
        plan = (
            F.when(k.isin("monthly", "admin_monthly"), "monthly").when(k.isin("one_time", "admin_one_time"), "one_time").when((k == "admin_revoke") | ((k == "ended") & (s.plan == "monthly")), "unknown").otherwise(s.plan)
        )
        seen = F.when(e.event_id.isNotNull() & (k != "use"), F.array_append(s.seen, e.event_id)).otherwise(s.seen)
        new = F.struct(F.lit(True).alias("known"), passes.cast("int").alias("passes"), expires.alias("expires_at"), plan.alias("plan"), seen.alias("seen"), e.at.alias("updated_at"))
        return F.when(skip, s).otherwise(new.cast(state))

    return folded.select(key, F.aggregate("events", start, step).alias("s")).select(key, "s.*").where("known").drop("known")


def status(records: DataFrame, now: Column, admins: list[str], key: str = "email") -> DataFrame:
    """``is_premium, plan, expires_at, passes`` of each record: admin before active subscription before pass before the stored plan."""
    admin = email_key(F.col(key).cast("string")).isin(*admins) if admins else F.lit(False)
    active, held = F.coalesce(F.col("expires_at") > now, F.lit(False)), F.coalesce("passes", F.lit(0)) > 0
    return records.select(
        key,
        (admin | active | held).alias("is_premium"),
        F.when(admin, "admin").when(active, "monthly").when(held, "one_time").otherwise(F.col("plan")).alias("plan"),
        F.when(~admin & active, F.col("expires_at")).alias("expires_at"),
        F.when(admin, 0).otherwise(F.greatest(F.lit(0), F.coalesce("passes", F.lit(0)))).cast("int").alias("passes"),
    )


def user_rollup(sessions: DataFrame, premium: DataFrame) -> DataFrame:
    """Sessions (``email, name, seq, updated_at``) and records (``email, updated_at, is_premium, plan, passes``) by normalised email.

    The record's time overrides the sessions' latest.
    """
    s = sessions.select(email_key(F.col("email")).alias("email"), F.nullif("name", F.lit("")).alias("name"), "seq", "updated_at")
    s = s.groupBy("email").agg(F.count("*").alias("session_count"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.max("updated_at").alias("_seen"))
    p = premium.withColumn("email", email_key(F.col("email"))).withColumnRenamed("updated_at", "_record")
    out = s.join(p, "email", "full")
    return out.select("email", "name", F.coalesce("session_count", F.lit(0)).alias("session_count"), F.coalesce("is_premium", F.lit(False)).alias("is_premium"), "plan", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("_record", "_seen").alias("updated_at"))


def summary(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("users"), F.count_if("is_premium").alias("premium_users"), F.count_if(F.col("plan") == "monthly").alias("monthly_users"), F.coalesce(F.sum("passes"), F.lit(0)).cast("long").alias("passes"))


def search_page(users: DataFrame, text: str, order: list[Column], offset: int, limit: int, columns: tuple[str, ...] = ("email", "name"), also: Column | None = None) -> DataFrame:
    """A page of the users with ``text`` in one of the columns, whatever the case, with the ``total`` before paging.

    The total is an aggregate joined to the page, so the page's rows are a bounded top-k and no window gathers all users.
    """
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    found = users.where(hit if also is None else hit & also)
    return found.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(found.agg(F.count("*").alias("total"))))


def audit_tail(rows: DataFrame, seq: str, limit: int | None) -> DataFrame:
    """The last rows in order of appending, newest first; the limit is 50 where none or 0 is given, and at most 200."""
    return rows.orderBy(F.desc(seq)).limit(min(200, max(1, limit or 50)))


def live_sessions(sessions: DataFrame, created: str, now: Column, days: int = 30) -> DataFrame:
    """Sessions whose fixed lifetime from creation isn't over, with ``expires_at``."""
    expires = F.col(created) + F.make_interval(days=F.lit(days))
    return sessions.withColumn("expires_at", expires).where(F.col("expires_at") > now)


def latest_status(changes: DataFrame, job: str, seq: str, columns: list[str]) -> DataFrame:
    """The last state of each job."""
    return changes.groupBy(job).agg(F.max_by(F.struct(*columns), seq).alias("s")).select(job, "s.*")


def swept(jobs: DataFrame, at: str, now: Column, minutes: int = 10) -> DataFrame:
    """What a sweep at ``now`` removes: jobs older than their lifetime."""
    return jobs.where(F.col(at) + F.make_interval(mins=F.lit(minutes)) < now)


def password_strength(password: Column) -> tuple[Column, Column]:
    """Score 0 to 5 (8 and 12 characters, both cases, a digit, another sign) and its label."""
    rules = [F.length(password) >= 8, F.length(password) >= 12, password.rlike("[A-Z]") & password.rlike("[a-z]"), password.rlike("[0-9]"), password.rlike("[^A-Za-z0-9]")]
    score = sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))
    return score, F.when(F.length(password) == 0, "입력 전").when(score <= 2, "약함").when(score <= 4, "보통").otherwise("강함")


def skip_histogram(rows: DataFrame, reason: Column) -> DataFrame:
    """How many rows each reason skips; rows without a reason are left out."""
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
