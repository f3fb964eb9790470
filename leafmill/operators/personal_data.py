"""Detection of personal data in plain and in positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import masking as M
from leafmill.functions import text as X

KINDS = tuple(M.PRIORITY)


def _kept(kind: str, text: Column) -> Column:
    """A kind's accepted matches in ``text`` as ``array<struct<type, start, length, text, masked_text, verified>>``."""
    if kind in ("rrn", "phone"):
        hits = F.filter(M.located(text, M.PATTERNS[kind]), lambda m: ~M.business_number(text, m.start, F.length(m.text)))
    else:
        hits = M.located(text, M.RUN_AS.get(kind, M.PATTERNS[kind]))
        if kind == "account":
            hits = F.filter(hits, lambda m: (F.length(M.digits_of(m.text)) >= 10) & ~F.coalesce(M.date_shaped(m.text), F.lit(False)))
        elif kind == "card":
            hits = F.filter(hits, lambda m: (F.length(M.digits_of(m.text)) == 16) & M.luhn(M.digits_of(m.text)))
    shown = {"rrn": M.format_rrn, "phone": M.format_phone}.get(kind, lambda t: t)
    mask = getattr(M, f"mask_{kind}")
    sure = {"rrn": M.valid_rrn, "card": lambda t: F.lit(True)}.get(kind, lambda t: F.lit(None).cast("boolean"))
    return F.transform(
        hits,
        lambda m: F.struct(F.lit(kind).alias("type"), m.start.alias("start"), F.length(m.text).alias("length"), shown(m.text).alias("text"), mask(m.text).alias("masked_text"), sure(m.text).alias("verified")),
    )


def matches(plain: Column, raw: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """All accepted matches, in the order rrn, phone, email, account, card; the first two are looked for in ``plain``.

    Both are columns, not expressions: the lambdas inside name them again and again.
    """
    order = [k for k in ("rrn", "phone", "email", "account", "card") if k in kinds]
    return F.concat(*(_kept(k, plain if k in ("rrn", "phone") else raw) for k in order))


def detect_preview(docs: DataFrame, keys: list[str], text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows ``keys, type, text, masked_text, verified``: detections in plain text, each text once by the strongest kind.

    rrn and phone are looked for in the text without white space, the others as it stands.
    """
    plain = docs.select(*keys, F.col(text).alias("__raw"), M.no_space(F.col(text)).alias("__plain"))
    found = plain.select(*keys, F.posexplode(matches(F.col("__plain"), F.col("__raw"), kinds)).alias("seq", "m")).select(*keys, "seq", "m.*")
    # The window's rows are one document's: its key is whatever tells documents apart.
    rank = F.element_at(F.create_map(*(x for k, v in M.PRIORITY.items() for x in (F.lit(k), F.lit(v)))), F.col("type"))
    first = F.row_number().over(W.partitionBy(*keys, "text").orderBy(rank.desc(), "seq"))
    return found.withColumn("_n", first).where("_n = 1").select(*keys, "type", "text", "masked_text", "verified")


def _pages(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each page: its ``items`` in order, with the place of their first character and the size of each."""
    n = F.length("str")
    a, d, x, y = (F.coalesce(F.get("transform", F.lit(i)), F.lit(0.0)) for i in (0, 3, 4, 5))
    wide = F.when(F.col("width") > 0, F.col("width") / n).when(F.abs(a) != 0, F.abs(a)).otherwise(8.0)
    tall = F.when(F.abs(d) != 0, F.abs(d)).when(F.coalesce("height", F.lit(0.0)) != 0, F.col("height")).otherwise(12.0)
    item = F.struct("item_seq", "str", x.alias("x"), y.alias("y"), wide.alias("w"), tall.alias("h"))
    return items.where(n > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))  # one page's items


def _plain() -> Column:
    return M.no_space(F.array_join(F.transform("items", lambda i: i.str), ""))


def _boxes() -> Column:
    return F.flatten(
        F.transform(
            "items",
            lambda i: F.filter(
                F.transform(F.split(i.str, ""), lambda c, k: F.struct(c.alias("c"), (i.x + k * i.w).alias("x"), i.y.alias("y"), i.w.alias("w"), i.h.alias("h"))),
                lambda q: ~q.c.rlike(f"^{M.WS}$") & (q.c != ""),
            ),
        )
    )


def characters(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each page: its text without white space and each character's box, in item order.

    ``items`` has ``keys``, ``item_seq``, ``str``, ``transform`` (six numbers), ``width`` and ``height``.
    """
    return _pages(items, keys).select(*keys, _plain().alias("plain"), _boxes().alias("chars"))


def detect_positioned(items: DataFrame, keys: list[str], kinds: tuple[str, ...] = KINDS, shown: tuple[str, ...] = ("rrn", "phone", "email")) -> DataFrame:
    """Rows ``keys, seq, type, text, masked_text, verified, x, y, width, height`` of detections in positioned text.

    All kinds are looked for in the page's text without white space. A detection goes if more than half of its own area lies in one
    that was kept before it, strongest kind first; kinds outside ``shown`` are dropped only after that.
    """
    # Only pages with a match need their characters' boxes.  A page is searched where its row is made: a filter on the matches would search it once more, and
    # make its text anew wherever a match names it.
    hits = F.array(X.bound(_plain(), lambda t: matches(t, t, kinds)))
    pages = _pages(items, keys).select(*keys, "items", F.explode(F.filter(hits, lambda h: F.size(h) > 0)).alias("hits")).select(*keys, "hits", _boxes().alias("chars"))

    def boxed(m: Column) -> Column:
        part = F.slice("chars", m.start + 1, m.length)
        side = lambda f, g: g(F.transform(part, f))
        x, y = side(lambda q: q.x, F.array_min), side(lambda q: q.y, F.array_min)
        x2, y2 = side(lambda q: q.x + q.w, F.array_max), side(lambda q: q.y + q.h, F.array_max)
        rank = F.element_at(F.create_map(*(v for k, p in M.PRIORITY.items() for v in (F.lit(k), F.lit(-p)))), m["type"])
        return F.struct(rank.alias("rank"), m.start.alias("start"), *(m[c].alias(c) for c in ("type", "text", "masked_text", "verified")), x.alias("x"), y.alias("y"), (x2 - x).alias("width"), (y2 - y).alias("height"))

    ordered = F.array_sort(F.transform("hits", boxed))
    found = pages.select(*keys, ordered.alias("found"))
    kind = found.schema["found"].dataType.simpleString()

    def covered(k: Column, m: Column) -> Column:
        over = lambda p, s: F.greatest(F.lit(0.0), F.least(m[p] + m[s], k[p] + k[s]) - F.greatest(m[p], k[p]))
        return over("x", "width") * over("y", "height") / (m.width * m.height) > 0.5

    kept = F.aggregate("found", F.from_json(F.lit("[]"), kind), lambda acc, m: F.when(F.exists(acc, lambda k: covered(k, m)), acc).otherwise(F.array_append(acc, m)))
    out = found.select(*keys, F.posexplode(kept).alias("seq", "m"))
    return out.select(*keys, "seq", *(F.col(f"m.{c}").alias(c) for c in ("type", "text", "masked_text", "verified", "x", "y", "width", "height"))).where(F.col("type").isin(*shown))
