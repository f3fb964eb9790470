"""Zip archives in binary columns, told apart by their central directory and put together from parts, in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures, and the most bytes that the end record and its comment take.
LOCAL, CENTRAL, END, LAST = "504B0304", "504B0102", "504B0506", 65557
_ENTRY = "struct<name:string,size:bigint,offset:bigint>"


def _le(hexed: Column, at: Column | int, size: int) -> Column:
    """A little-endian number at a place of hex text, from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    pairs = [F.substr(hexed, at + 2 * i + 1, F.lit(2)) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def _bytes(value: Column, size: int) -> Column:
    """A number as hex text of little-endian bytes."""
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))


def end_record(content: Column) -> Column:
    """``struct<n, size, offset>`` of the central directory; null where there is none.

    The record is looked for from the end: it is the one whose comment is just as long as what follows.
    """
    tail = F.hex(F.substr(content, F.greatest(F.lit(1), F.length(content) - LAST + 1), F.lit(LAST)))
    parts = F.split(tail, END)
    behind = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), END))
    whole = F.filter(behind, lambda r: (F.length(r) >= 36) & (F.length(r) % 2 == 0) & (_le(r, 32, 2) * 2 == F.length(r) - 36))
    r = F.element_at(whole, -1)
    found = F.struct(_le(r, 12, 2).alias("n"), _le(r, 16, 4).alias("size"), _le(r, 24, 4).alias("offset"))
    return F.when((F.size(parts) > 1) & (F.size(whole) > 0), found)


def entries(content: Column, end: Column) -> Column:
    """Names, unpacked sizes and offsets in the central directory's order; null where the content is no whole archive.

    ``end`` is :func:`end_record` as a column of its own.  Archives beyond 4 GB or 65,535 entries have another record and count as none.
    """
    h = F.hex(F.substr(content, (end["offset"] + 1).cast("int"), end["size"].cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.from_json(F.lit("[]"), f"array<{_ENTRY}>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        n, extra, comment = (_le(h, at + 2 * k, 2) for k in (28, 30, 32))
        entry = F.struct(F.decode(F.unhex(F.substr(h, at + 93, 2 * n)), "UTF-8").alias("name"), _le(h, at + 48, 4).alias("size"), _le(h, at + 84, 4).alias("offset"))
        good = F.substr(h, at + 1, F.lit(8)) == CENTRAL
        return F.when(good, F.struct((at + 92 + 2 * (n + extra + comment)).alias("at"), F.array_append(acc["out"], entry).alias("out"))).otherwise(acc)

    walked = F.aggregate(F.when(end["n"] > 0, F.sequence(F.lit(1).cast("long"), end["n"])).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["out"])
    return F.when(end.isNotNull() & (F.size(walked) == end["n"]), walked)


def archive_kind(names: Column) -> Column:
    """What an archive is by the names in it: ``docx``, ``hwpx``, ``epub``, ``odf`` or ``zip``; null for no archive."""
    has = lambda name: F.array_contains(names, name)
    return (
        F.when(has("[Content_Types].xml") & has("word/document.xml"), "docx")
        .when(has("Contents/content.hpf") | F.exists(names, lambda n: n.contains("Contents/section")), "hwpx")
        .when(has("META-INF/container.xml"), "epub").when(has("content.xml") & has("META-INF/manifest.xml"), "odf").when(names.isNotNull(), "zip")
    )


def zip_stored(parts: Column) -> Column:
    """An archive of ``array<struct<name, content>>``, its parts as they are; names are ASCII or UTF-8."""

    def head(p: Column) -> Column:  # what both headers of a part share
        size = F.length(p["content"])
        return F.concat(F.lit("14000008000000002100"), _bytes(F.crc32(p["content"]), 4), _bytes(size, 4), _bytes(size, 4), _bytes(F.octet_length(p["name"]), 2), F.lit("0000"))

    state = F.struct(F.lit(0).cast("long").alias("at"), F.unhex(F.lit("")).alias("body"), F.unhex(F.lit("")).alias("directory"))

    def step(acc: Column, p: Column) -> Column:
        name = F.encode(p["name"], "UTF-8")
        local = F.concat(F.unhex(F.concat(F.lit(LOCAL), head(p))), name, p["content"])
        central = F.concat(F.unhex(F.concat(F.lit(CENTRAL + "1400"), head(p), F.lit("0000" * 3 + "00000000"), _bytes(acc["at"], 4))), name)
        return F.struct((acc["at"] + F.length(local)).alias("at"), F.concat(acc["body"], local).alias("body"), F.concat(acc["directory"], central).alias("directory"))

    def finish(acc: Column) -> Column:
        n = _bytes(F.size(parts), 2)
        return F.concat(acc["body"], acc["directory"], F.unhex(F.concat(F.lit(END + "00000000"), n, n, _bytes(F.length(acc["directory"]), 4), _bytes(acc["at"], 4), F.lit("0000"))))

    return F.aggregate(parts, state, step, finish)
