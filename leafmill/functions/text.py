"""Markup, path, unit and formatting functions, as column expressions."""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.masking import WS


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, however often it stands in what is made."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


#: The characters of :data:`WS` one by one.
_SPACES = " \t\n\v\f\r" + "".join(c for c in map(chr, range(0x80, 0x10000)) if re.match(WS, c) and c not in "\x85")


def trim_ws(s: Column) -> Column:
    """Without white space at either end; by its characters, as a pattern is tried at every character of a long text."""
    return F.btrim(s, F.lit(_SPACES))


def attributes(s: Column) -> Column:
    """The ``name="value"`` pairs of a tag as a map; the last of equal names counts."""
    pattern = F.lit(r'([\w:-]+)="([^"]*)"')
    found = F.struct(F.regexp_extract_all(s, pattern, F.lit(1)).alias("names"), F.regexp_extract_all(s, pattern, F.lit(2)).alias("values"))

    def last(f: Column) -> Column:
        pairs = F.zip_with(f["names"], f["values"], lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        kept = F.filter(pairs, lambda p, i: F.size(f["names"]) - F.array_position(F.reverse(f["names"]), p.k) == i)
        once = F.size(F.array_distinct(f["names"])) == F.size(f["names"])
        some = F.when(once, F.map_from_arrays(f["names"], f["values"])).otherwise(F.map_from_entries(kept))
        return F.when(F.size(f["names"]) > 0, some).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))

    return bound(found, last)


def _numeric(s: Column, pattern: str, base: int) -> Column:
    """Numeric character references decoded; piece by piece between the matches."""
    char = lambda r: F.decode(F.unhex(F.lpad(F.hex(F.conv(r, base, 10).cast("long")), 8, "0")), "UTF-32")

    def joined(v: Column, refs: Column) -> Column:
        pieces = F.zip_with(F.split(v, pattern, -1), refs, lambda g, r: F.concat(F.coalesce(g, F.lit("")), F.when(r.isNull(), "").otherwise(char(r))))
        return F.when(F.size(refs) > 0, F.array_join(pieces, "")).otherwise(v)

    return bound(s, lambda v: bound(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)), lambda refs: joined(v, refs)))


def decode_entities(s: Column) -> Column:
    """Breaks to line feeds, tags away, then lt, gt, quot, apos, amp, decimal and hexadecimal references in this order, so ``&amp;#65;`` is decoded twice."""
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return _numeric(_numeric(s, r"&#(\d+);", 10), r"(?i)&#x([0-9a-f]+);", 16)


def decode_odf(s: Column) -> Column:
    """ODF spaces, tabs and line breaks, then entities; white space around line feeds goes."""
    counted = r'<text:s\b[^>]*text:c="(\d+)"[^>]*/>'
    counts, gaps = F.regexp_extract_all(s, F.lit(counted), F.lit(1)), F.split(s, counted, -1)
    spaced = F.array_join(F.zip_with(gaps, counts, lambda g, c: F.concat(g, F.when(c.isNull(), "").otherwise(F.repeat(F.lit(" "), F.greatest(c.cast("int"), F.lit(1)))))), "")
    s = F.when(F.size(counts) > 0, spaced).otherwise(s)
    for pattern, char in ((r"<text:s\b[^>]*/>", " "), (r"<text:tab\b[^>]*/>", "\t"), (r"<text:line-break\b[^>]*/>", "\n"), ("<[^>]+>", "")):
        s = F.regexp_replace(s, pattern, char)
    return trim_ws(F.regexp_replace(F.regexp_replace(decode_entities(s), r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"))


def normal_word(s: Column) -> Column:
    return trim_ws(F.regexp_replace(decode_entities(s), f"{WS}+", " "))


def sanitize_line(s: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(trim_ws(s), f"{WS}+", " "), 1, max(1, most))


def sanitize_message(s: Column, most: int) -> Column:
    return F.substring(trim_ws(F.replace(s, F.lit("\r"), F.lit(""))), 1, max(1, most))


def escape_html(s: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        s = F.replace(s, F.lit(char), F.lit(f"&{name};"))
    return s


def form_feed_pages(s: Column) -> Column:
    """Pages between form feeds, blank ones dropped."""
    return F.filter(F.transform(F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), "\f"), trim_ws), lambda p: p != "")


def text_blocks(s: Column, page: Column, pages: Column) -> Column:
    """Lines with text, right-trimmed, behind a page mark if there are several pages; a note if nothing is left."""
    lines = F.filter(F.transform(F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, f"{WS}+$", "")), lambda x: x != "")
    marked = F.when(pages > 1, F.concat(F.array(F.concat(F.lit("["), (page + 1).cast("string"), F.lit("페이지]"))), lines)).otherwise(lines)
    none = F.array(F.lit("PDF에서 추출 가능한 텍스트가 없습니다. 스캔 이미지 PDF는 OCR 단계가 필요합니다."))
    return F.when(F.size(marked) > 0, marked).otherwise(none)


#: What Markdown inside a line becomes, in this order; a dot is any character but a line feed.
INLINE = (
    (r"!\[([^\]]*)\]\(([^)]+)\)", '<img src="$2" alt="$1">'),
    (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"__(.+?)__", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"),
    (r"_(.+?)_", "<em>$1</em>"),
    (r"`([^`]+)`", "<code>$1</code>"),
)


def markdown_inline(s: Column) -> Column:
    """Images, links, bold, italics and code; underscore italics also apply inside snake_case words."""
    for pattern, out in INLINE:
        s = F.regexp_replace(s, f"(?d){pattern}", out)
    return s


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?", 1)


def normal_path(path: Column) -> Column:
    """``.`` and empty parts go, ``..`` takes the part before it along."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.from_json(F.lit("[]"), "array<string>")
    walked = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(walked, "/")


def resolve_path(base: Column, relative: Column) -> Column:
    """A percent-decoded path below a folder (a plus sign stays one); what can't be decoded is taken as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))), relative)
    return normal_path(F.concat(F.coalesce(base, F.lit("")), decoded))


def clean_href(href: Column) -> Column:
    return F.substring_index(F.substring_index(href, "#", 1), "?", 1)


def inside_root(href: Column) -> Column:
    """Whether a reference is relative and stays below its root."""
    depth = F.aggregate(
        F.filter(F.split(href, "/"), lambda p: ~p.isin("", ".")),
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda a, p: F.struct(F.when(p == "..", a.d - 1).otherwise(a.d + 1).alias("d"), (a.out | ((p == "..") & (a.d <= 0))).alias("out")),
        lambda a: a.out & (a.d < 1),
    )
    return F.coalesce((href != "") & ~href.rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~href.startswith("/") & ~depth, F.lit(False))


def mime_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".jpg") | p.endswith(".jpeg"), "image/jpeg").when(p.endswith(".png"), "image/png").when(p.endswith(".gif"), "image/gif").when(p.endswith(".webp"), "image/webp").when(p.endswith(".svg"), "image/svg+xml")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def safe_redirect(value: Column) -> Column:
    """A local path; ``/`` for anything else."""
    return F.when(value.startswith("/") & ~value.startswith("//"), value).otherwise("/")


def cookies(header: Column) -> Column:
    """Cookie names and values; a value keeps its own equals signs."""
    pairs = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substr(p, F.instr(p, "=") + 1)))))


#: Fonts by parts of their lower-case names, the first that applies.
FONTS = (
    ("gungsuh|궁서", "Gungsuh"), ("gulim|굴림", "Gulim"), ("batang|바탕", "Batang"), ("dotum|돋움", "Dotum"), ("malgun|맑은", "Malgun Gothic"),
    ("noto.*cjk|cjk.*noto", "Noto Sans CJK KR"), ("arial|helv|nimbus sans", "Nimbus Sans"), ("times|nimbus roman", "Nimbus Roman"), ("courier|nimbus mono", "Nimbus Mono PS"),
)
DEFAULT_FONT = "함초롬바탕"


def normal_font(raw: Column) -> Column:
    """A font's family, its subset prefix dropped."""
    name = F.regexp_replace(raw, r"^[^+]*\+", "")
    out = F.when(F.coalesce(raw, F.lit("")) == "", DEFAULT_FONT)
    for pattern, family in FONTS:
        out = out.when(F.lower(name).rlike(pattern), family)
    return out.otherwise(name)


def colour_of_int(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(value.cast("long").bitwiseAND(0xFFFFFF)), 6, "0"))


def colour_of_rgb(r: Column, g: Column, b: Column) -> Column:
    """Channels of 0 to 1, clamped, to ``#RRGGBB``; halves round to even."""
    part = lambda c: F.lpad(F.hex(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255, 0).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


_LENGTH = r"(?i)^(-?\d+(?:\.\d+)?)(in|cm|mm|pt|px)?$"


def _length(s: Column, per_inch: float, default: str, fallback: float) -> Column:
    amount, unit = F.regexp_extract(F.trim(s), _LENGTH, 1), F.lower(F.regexp_extract(F.trim(s), _LENGTH, 2))
    unit = F.when(unit == "", default).otherwise(unit)
    inches = F.when(unit == "in", 1.0).when(unit == "cm", 1 / 2.54).when(unit == "mm", 1 / 25.4).when(unit == "pt", 1 / 72).otherwise(1 / 96)
    return F.when(F.coalesce(amount, F.lit("")) == "", F.lit(float(fallback))).otherwise(amount.try_cast("double") * inches * per_inch)


def odf_px(s: Column, fallback: float = 0.0) -> Column:
    """An ODF length in pixels of 1/96 inch; without a unit pixels are meant."""
    return _length(s, 96.0, "px", fallback)


def odf_pt(s: Column, fallback: float = 12.0) -> Column:
    """An ODF length in points; without a unit points are meant."""
    return _length(s, 72.0, "pt", fallback)


def px_to_mm(px: Column) -> Column:
    return F.floor(px * 25.4 / 96 * 1000 + 0.5) / 1000


def hwp_of_cm(cm: Column) -> Column:
    return (cm / 2.54 * 7200).cast("long")


def hwp_of_pt(pt: Column) -> Column:
    return (pt * 100).cast("long")


def mm_of_hwp(unit: Column) -> Column:
    return unit / 7200 * 25.4


def clamp(value: Column, low: float, high: Column) -> Column:
    return F.greatest(F.lit(low), F.least(high, value))


def image_fit(width: Column, height: Column, max_width: float = 600, max_height: float = 800, padding: float = 50) -> tuple[Column, Column, Column, Column]:
    """Image and page size: shrunk to fit with its ratio kept, padded all around."""
    scale = F.least(F.lit(1.0), max_width / width, max_height / height)
    return width * scale, height * scale, width * scale + 2 * padding, height * scale + 2 * padding


def corner(place: Column, page_w: Column, page_h: Column, w: Column, h: Column, margin: float = 50) -> tuple[Column, Column]:
    """Where a stamp's lower left corner lies for a named place; the page's centre for others."""
    x = F.when(place.endswith("left"), F.lit(margin)).when(place.endswith("right"), page_w - w - margin).otherwise((page_w - w) / 2)
    y = F.when(place.startswith("top"), page_h - h - margin).when(place.startswith("bottom"), F.lit(margin)).otherwise((page_h - h) / 2)
    return x, y


def saved_percent(before: Column, after: Column) -> Column:
    """Size reduction in whole percent, never below 0 (halves round up)."""
    return F.greatest(F.lit(0).cast("long"), F.floor((1 - after / before) * 100 + 0.5))


#: Relative widths of ASCII characters in hundredths; all others have 100.
GLYPH_WEIGHTS = np.full(128, 52)
for _chars, _weight in ((string.ascii_uppercase + string.digits, 62), ("MW@#%&", 90), ("fjt[]()", 36), ("ilI.,:;!'`|", 28)):
    GLYPH_WEIGHTS[[*_chars.encode()]] = _weight
