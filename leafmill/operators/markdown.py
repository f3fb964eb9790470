"""Markdown as HTML, as a plan over lines: what a line is, which fence, list and table it belongs to, and where each piece of HTML stands.

Fences are told by the parity of their marks.  A list is an island of items between lines that end it.  A table's rows are gathered up
to the first line that lets it go; rules and headings don't, so that they stand in front of a table that began before them.  Every
piece of HTML has a place, the line and a rank in it, and a document is its pieces in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X

#: Ranks of the pieces of one line: the end of a list, a table let go, the begin of a list, the line itself.
_END, _TABLE, _BEGIN, _OWN = range(4)
_BLANK = r"[\s\x1c-\x1f]"


def _kind(s: Column) -> Column:
    """What a stripped line outside fences is."""
    cells = F.slice(F.split(s, r"\|"), 2, F.greatest(F.size(F.split(s, r"\|")) - 2, F.lit(0)))
    divider = F.forall(cells, lambda c: _strip(c).rlike(r"^[-:]+$"))
    return (
        F.when(s.rlike(r"^(?:---+|\*\*\*+|___+)$"), "rule").when(s.rlike(rf"(?dU)^#{{1,6}}{_BLANK}+.+$"), "heading")
        .when(s.startswith("|"), F.when(divider, "divider").otherwise("row")).when(s.rlike(r"^[-*+] "), "ul").when(s.rlike(rf"(?dU)^\d+\.{_BLANK}+.+$"), "ol")
        .when(s.startswith("> "), "quote").when(s == "", "blank").otherwise("paragraph")
    )


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def _own(s: Column, raw: Column, kind: Column) -> Column:
    """A line's own HTML; null where it has none."""
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), X.markdown_inline(body), F.lit(f"</{name}>"))
    level = F.length(F.regexp_extract(s, "^#+", 0)).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(">"), X.markdown_inline(F.regexp_extract(s, rf"(?dU)^#{{1,6}}{_BLANK}+(.+)$", 1)), F.lit("</h"), level, F.lit(">"))
    code = raw
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        code = F.replace(code, F.lit(plain), F.lit(escaped))
    lang = _strip(F.substr(s, F.lit(4)))
    opened = F.concat(F.lit("<pre><code"), F.when(lang != "", F.concat(F.lit(' class="language-'), lang, F.lit('"'))).otherwise(""), F.lit(">"))
    return (
        F.when(kind == "open", opened).when(kind == "close", "</code></pre>").when(kind == "code", code).when(kind == "rule", "<hr>").when(kind == "heading", head)
        .when(kind == "ul", tag("li", F.substr(s, F.lit(3)))).when(kind == "ol", tag("li", F.regexp_extract(s, rf"(?dU)^\d+\.{_BLANK}+(.+)$", 1)))
        .when(kind == "quote", tag("blockquote", F.substr(s, F.lit(3)))).when(kind == "blank", "").when(kind == "paragraph", tag("p", s))
    )


def _row(s: Column) -> Column:
    cells = F.slice(F.split(s, r"\|"), 2, F.size(F.split(s, r"\|")) - 2)
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), X.markdown_inline(_strip(c)), F.lit("</td>"))), ""), F.lit("</tr>"))


def markdown_html(docs: DataFrame, keys: list[str], text: str = "text", out: str = "html") -> DataFrame:
    """``keys`` and the HTML of each document, which ``keys`` tell apart; null counts as empty."""
    each = W.partitionBy(*keys).orderBy("i")
    before = each.rowsBetween(W.unboundedPreceding, -1)
    lines = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "raw")).withColumn("s", _strip(F.col("raw")))
    mark = F.col("s").startswith("```")
    lines = lines.withColumn("inside", F.coalesce(F.sum(mark.cast("int")).over(before), F.lit(0)) % 2 == 1)
    lines = lines.withColumn("kind", F.when(mark, F.when(F.col("inside"), "close").otherwise("open")).when(F.col("inside"), "code").otherwise(_kind(F.col("s"))))
    free = ~F.col("kind").isin("open", "close", "code")
    item = F.col("kind").isin("ul", "ol")
    ends = free & ~item & ~F.col("s").rlike(r"(?U)^\d+\.")
    frees = free & ~F.col("kind").isin("rule", "heading", "divider", "row")
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    # The list before a line, and whether a line has ended it since: both from what stands before.
    lines = lines.withColumns({"ended": count(ends), "group": count(frees)})
    held = F.struct("kind", F.col("ended").alias("at"))
    lines = lines.withColumn("held", F.last(F.when(item, held), ignorenulls=True).over(before))
    live = F.when(F.col("held.at") == F.col("ended"), F.col("held.kind"))
    lines = lines.withColumns({"list": live, "ends": ends, "frees": frees})
    closing = F.concat(F.lit("</"), F.col("list"), F.lit(">"))
    begun = F.when(item & ~F.col("list").eqNullSafe(F.col("kind")), F.concat(F.when(F.col("list").isNotNull(), F.concat(closing, F.lit("\n"))).otherwise(""), F.lit("<"), F.col("kind"), F.lit(">")))
    piece = lambda rank, html: F.struct(F.col("i").cast("long").alias("i"), F.lit(rank).alias("rank"), html.alias("html"))
    own = F.filter(F.array(piece(_END, F.when(F.col("ends"), closing)), piece(_BEGIN, begun), piece(_OWN, _own(F.col("s"), F.col("raw"), F.col("kind")))), lambda p: p["html"].isNotNull())
    # The rows of a table, and with them the line that lets them go, are the lines between two such lines; a document is what its stretches give. One grouping inside
    # the other, both by what the lines were dealt by.
    end = F.lit((1 << 31) - 1).cast("long")
    state = F.struct(F.when(item, F.col("kind")).when(~ends, F.col("list")).alias("list"))
    stretches = lines.groupBy(*keys, "group").agg(
        F.flatten(F.collect_list(own)).alias("ps"), F.array_sort(F.collect_list(F.when(F.col("kind") == "row", F.struct("i", _row(F.col("s")).alias("html"))))).alias("rows"),
        F.max(F.when(F.col("frees"), F.col("i").cast("long"))).alias("let_go"), F.sum(mark.cast("int")).alias("marks"), F.max_by(state, "i").alias("o"), F.max("i").alias("at"),
    )
    table = F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["html"]), ""), F.lit("</table>"))
    placed = F.struct(F.coalesce("let_go", end).alias("i"), F.lit(_TABLE).alias("rank"), F.when(F.size("rows") > 0, table).alias("html"))
    stretches = stretches.withColumn("ps", F.concat("ps", F.filter(F.array(placed), lambda p: p["html"].isNotNull())))
    whole = stretches.groupBy(*keys).agg(F.flatten(F.collect_list("ps")).alias("ps"), F.sum("marks").alias("marks"), F.max_by("o", "at").alias("o"))  # a document is one text
    # What is open when the text ends: a fence, then a list.
    tail = lambda rank, html: F.struct(end.alias("i"), F.lit(rank).alias("rank"), html.alias("html"))
    open_ = F.filter(F.array(tail(_END - 1, F.when(F.col("marks") % 2 == 1, F.lit("</code></pre>"))), tail(_END, F.concat(F.lit("</"), F.col("o.list"), F.lit(">")))), lambda p: p["html"].isNotNull())
    whole = whole.select(*keys, F.array_sort(F.concat("ps", open_)).alias("ps"))
    html = whole.select(*keys, F.array_join(F.transform("ps", lambda p: p["html"]), "\n").alias(out))
    return docs.select(*keys).join(html, keys, "left").withColumn(out, F.coalesce(out, F.lit("")))
