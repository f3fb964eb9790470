"""Styles of exported documents: fonts, colours, sizes and CSS, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import px_to_mm

#: Fonts by parts of their lower-case names for word documents, the first that applies.
DOCUMENT_FONTS = (
    ("gungsuh|궁서", "Gungsuh"), ("gulim|굴림", "Gulim"), ("batang|바탕", "Batang"), ("dotum|돋움", "Dotum"), ("malgun|맑은", "Malgun Gothic"), ("arial", "Arial"), ("times", "Times New Roman"),
)
#: The same for exports, where faces of equal widths stand in.
EXPORT_FONTS = (
    ("helv|nimbus sans", "Nimbus Sans"), ("arial", "Nimbus Sans"), ("times|nimbus roman", "Nimbus Roman"), ("courier|nimbus mono", "Nimbus Mono PS"), ("liberation sans", "Nimbus Sans"), ("liberation serif", "Nimbus Roman"), ("liberation mono", "Nimbus Mono PS"),
)
#: Words that make a style a heading, alignments, and a page's size where it is unknown.
HEADINGS = ("제목", "머리말", "title", "heading")
ALIGN = {"LEFT": "left", "CENTER": "center", "RIGHT": "right", "JUSTIFY": "justify", "DISTRIBUTED": "justify"}
A4_MM = (210.0, 297.0)
FALLBACK_FACES = "'맑은 고딕','Apple SD Gothic Neo',sans-serif"


def _ruled(rules: tuple, lower: Column, otherwise: Column) -> Column:
    out = F
    for pattern, family in rules:
        out = out.when(lower.rlike(pattern), family)
    return out.otherwise(otherwise)


def document_font(raw: Column) -> Column:
    """A font's family by its name, else by what stands behind subset prefixes, else itself without them."""
    return _ruled(DOCUMENT_FONTS, F.lower(raw), F.regexp_replace(raw, r"^(?:[^+]*\+)+", ""))


def export_font(font: Column, fallback: str) -> Column:
    """A font's family with its subset prefix dropped and dashes as spaces; the fallback for an empty name."""
    trimmed = F.trim(font)
    bare = F.trim(F.replace(F.when(trimmed.contains("+"), F.regexp_replace(trimmed, r"^[^+]*\+", "")).otherwise(trimmed), F.lit("-"), F.lit(" ")))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", fallback).when(bare == "", fallback).otherwise(_ruled(EXPORT_FONTS, F.lower(bare), bare))


def _byte(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.regexp_replace(F.trim(value), "^#+", ""), at, 2), 16, 10).cast("int")


def _six(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(value), "^#+", "").rlike("(?i)^[0-9a-f]{6}$"), F.lit(False))


def rgb_of_hex(value: Column) -> Column:
    """``struct<r, g, b>`` from 0 to 1; null for no colour."""
    return F.when(_six(value), F.struct(*((_byte(value, i) / 255.0).alias(c) for c, i in (("r", 1), ("g", 3), ("b", 5)))))


def hwp_colour(value: Column) -> Column:
    """A colour as the number of its channels in reverse order; 0 for no colour."""
    return F.when(_six(value), _byte(value, 5) * 65536 + _byte(value, 3) * 256 + _byte(value, 1)).otherwise(0)


def colour_of_channels(r: Column, g: Column, b: Column) -> Column:
    """Channels from 0 to 1 (halves round to even) or, if one is above 1, of whole bytes, as ``#RRGGBB``."""
    unit = (r <= 1) & (g <= 1) & (b <= 1)
    part = lambda c: F.when(unit, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255, 0).cast("long")).otherwise(c.cast("long").bitwiseAND(255))
    return F.concat(F.lit("#"), *(F.lpad(F.hex(part(c)), 2, "0") for c in (r, g, b)))


def page_size_mm(width_px: Column, height_px: Column) -> tuple[Column, Column]:
    """A page's size in millimetres; A4's where a side isn't above 0."""
    side = lambda px, i: F.when(px_to_mm(px) > 0, px_to_mm(px)).otherwise(A4_MM[i])
    return side(width_px, 0), side(height_px, 1)


def hwp_of_mm(mm: Column) -> Column:
    """Millimetres in units of 1/7200 inch, rounded."""
    return F.round(mm * 7200 / 25.4).cast("long")


def pt_of_hwp(value: Column, otherwise: float = 0.0) -> Column:
    """Text of hundredths of a point as points; the other value for what is no whole number."""
    return F.coalesce(F.when(F.trim(value).rlike(r"^[+-]?\d+$"), value.try_cast("long") / 100.0), F.lit(otherwise))


def is_heading(style_name: Column) -> Column:
    lower = F.lower(F.coalesce(style_name, F.lit("")))
    return F.exists(F.array(*map(F.lit, HEADINGS)), lower.contains)


def _tenth(value: Column) -> Column:
    """A number with one decimal, halves to even."""
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def char_css(style: Column) -> Column:
    """CSS of a character style's map of attributes; missing ones have their defaults, and an empty map gives nothing."""
    get = lambda name, default: F.coalesce(style[name], F.lit(default))
    line = lambda name: ~get(name, "0").isin("", "0", "NONE")
    korean, latin = get("faceNameHangul", ""), get("faceNameLatin", "")
    faces = F.concat_ws(",", F.nullif(korean, F.lit("")), F.when((latin != "") & (latin != korean), latin))
    parts = F.concat_ws(
        ";",
        F.when(~get("height", "1000").isin("", "1000"), F.concat(F.lit("font-size:"), _tenth(pt_of_hwp(get("height", "1000"), 10.0)), F.lit("pt"))),
        F.when(~get("textColor", "#000000").isin("", "#000000", "black"), F.concat(F.lit("color:"), style["textColor"])),
        F.when(~get("shadeColor", "none").isin("", "none", "#FFFFFF"), F.concat(F.lit("background-color:"), style["shadeColor"])),
        F.when(get("bold", "0") == "1", "font-weight:bold"),
        F.when(get("italic", "0") == "1", "font-style:italic"),
        F.when(line("underline"), "text-decoration:underline"),
        F.when(line("strikeout"), "text-decoration:line-through"),
        F.when(~get("ratio", "100").isin("", "100"), F.concat(F.lit("font-size:"), style["ratio"].try_cast("int").cast("string"), F.lit("%"))),
        F.when(~get("spacing", "0").isin("", "0"), F.concat(F.lit("letter-spacing:"), _tenth(style["spacing"].try_cast("int") / 100.0), F.lit("pt"))),
        F.when(faces != "", F.concat(F.lit("font-family:"), faces, F.lit(f",{FALLBACK_FACES}"))),
    )
    return F.when(F.size(style) > 0, parts).otherwise("")


def para_css(align: Column) -> Column:
    """CSS of a paragraph style's alignment (left without one); nothing for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in ALIGN.items() for x in pair))[F.coalesce(align, F.lit("LEFT"))]
    return F.coalesce(F.concat(F.lit("text-align:"), known), F.lit(""))


def border_css(sides: Column, fill: Column) -> Column:
    """CSS of a cell's borders, a map from side to ``struct<type, width, colour>``, and its fill; a plain border where there is no style."""

    def one(side: str) -> Column:
        b = sides[side]
        none = F.coalesce(b["type"], F.lit("NONE")).isin("", "NONE")
        return F.when(none, f"border-{side}:none").otherwise(F.concat(F.lit(f"border-{side}:"), _tenth(b["width"]), F.lit("pt solid "), b["colour"]))

    parts = F.concat_ws(";", *map(one, ("top", "right", "bottom", "left")), F.when(~F.coalesce(fill, F.lit("")).isin("", "none"), F.concat(F.lit("background-color:"), fill)))
    return F.when(sides.isNull(), "border:1px solid #000").otherwise(parts)
