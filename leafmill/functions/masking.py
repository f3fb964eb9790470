"""Masks, checks and formats of personal data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the original rules, which is wider than Java's.
WS = r"[\s   -     　﻿]"

#: The detection patterns.
PATTERNS = {
    "rrn": r"(?<![A-Za-z0-9])\d{6}[-]?\d{7}(?![A-Za-z0-9])",
    "phone": r"(?:01[016789]-?\d{3,4}-?\d{4})|(?:0[2-6][1-5]?-?\d{3,4}-?\d{4})",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "account": r"\d{2,6}-\d{2,6}-\d{2,6}(?:-\d{1,3})?",
    "card": rf"\d{{4}}(?:-|{WS})?\d{{4}}(?:-|{WS})?\d{{4}}(?:-|{WS})?\d{{4}}",
}
#: Labels of registration numbers that aren't personal data, right before a number.
BUSINESS_LABEL = r"(구직\s*등록\s*번\s*호|구직등록번호|발급\s*번\s*호|발급번호|등록\s*번\s*호|등록번호)$"
#: How a pattern is run: equal matches, but a run of address characters is tried from its start (or the last match's end) only.
RUN_AS = {"email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}
#: Which kind wins where two claim the same text.
PRIORITY = {"rrn": 5, "phone": 4, "card": 3, "account": 2, "email": 1}


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def mask_rrn(text: Column) -> Column:
    """Six digits, a dash, the seventh, six stars; texts under 13 characters (first dash aside) unchanged."""
    plain = F.regexp_replace(text, "^([^-]*)-", "$1")
    return F.when(F.length(plain) < 13, text).otherwise(F.concat(F.substring(plain, 1, 6), F.lit("-"), F.substring(plain, 7, 1), F.lit("******")))


def mask_phone(text: Column) -> Column:
    """``ddd-****-dddd`` for 11 digits; else the last four characters become stars."""
    d = digits_of(text)
    return F.when(F.length(d) == 11, F.concat(F.substring(d, 1, 3), F.lit("-****-"), F.substr(d, F.lit(8)))).otherwise(
        F.concat(F.substr(text, F.lit(1), F.greatest(F.length(text) - 4, F.lit(0))), F.lit("****"))
    )


def mask_email(text: Column) -> Column:
    """First and last character of a local part over two characters, stars between; else the first and three stars. No domain: unchanged."""
    parts = F.split(text, "@", -1)
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    n = F.length(local)
    first = F.substring(local, 1, 1)
    long = F.concat(first, F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(0))), F.substr(local, n))
    return F.when(F.coalesce(domain, F.lit("")) == "", text).otherwise(F.concat(F.when(n > 2, long).otherwise(F.concat(first, F.lit("***"))), F.lit("@"), domain))


def mask_account(text: Column) -> Column:
    """The part after the last dash becomes four stars; without a dash the last four characters do."""
    parts = F.split(text, "-", -1)
    dashed = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "-"), F.lit("-****"))
    return F.when(F.size(parts) > 1, dashed).otherwise(F.concat(F.substr(text, F.lit(1), F.greatest(F.length(text) - 4, F.lit(0))), F.lit("****")))


def mask_card(text: Column) -> Column:
    """Second and third part become stars; a number without separators has one part and stays as it is."""
    parts = F.split(text, f"(?:-|{WS})", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i.isin(1, 2), F.lit("****")).otherwise(p)), "-")


def valid_rrn(text: Column) -> Column:
    """Weighted check digit of a 13-digit resident number."""
    d = F.transform(F.split(digits_of(text), ""), lambda c: c.cast("int"))
    weights = F.array(*(F.lit(w) for w in (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))
    total = F.aggregate(F.zip_with(F.slice(d, 1, 12), weights, lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
    return (F.length(digits_of(text)) == 13) & ((11 - total % 11) % 10 == F.get(d, F.lit(12)))


def luhn(text: Column) -> Column:
    """The Luhn check of a text of digits."""
    return F.call_function("luhn_check", text)


def format_rrn(text: Column) -> Column:
    plain = F.regexp_replace(text, "^([^-]*)-", "$1")
    return F.when(F.length(plain) != 13, text).otherwise(F.concat(F.substring(plain, 1, 6), F.lit("-"), F.substr(plain, F.lit(7))))


def format_phone(text: Column) -> Column:
    d = F.regexp_replace(text, "-", "")
    cut = lambda a, b: F.concat(F.substring(d, 1, a), F.lit("-"), F.substring(d, a + 1, b), F.lit("-"), F.substr(d, F.lit(a + b + 1)))
    n = F.length(d)
    return F.when(n == 11, cut(3, 4)).when((n == 10) & d.startswith("02"), cut(2, 4)).when(n == 10, cut(3, 3)).otherwise(text)


def date_shaped(text: Column) -> Column:
    """Whether an account-like text starts like a year, month and day."""
    p = F.split(text, "-")
    year, month, day = F.get(p, F.lit(0)), F.get(p, F.lit(1)).try_cast("int"), F.substring(F.get(p, F.lit(2)), 1, 2).try_cast("int")
    return (F.length(year) == 4) & year.try_cast("int").between(1900, 2099) & month.between(1, 12) & day.between(1, 31)


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<start, text>>``, start from 0 in code points; texts without a match are looked at once."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,text:string>>")

    def placed(z: Column) -> Column:
        ends = F.transform(z, lambda x: F.length(x["0"]) + F.length(x["1"]))
        # A text holds few matches: each start is a sum over those before it, with no array copied.
        before = lambda i: F.aggregate(F.slice(ends, 1, i), F.lit(0), lambda n, x: n + x)
        return F.transform(z, lambda x, i: F.struct((before(i) + F.length(x["0"])).alias("start"), x["1"].alias("text")))

    both = F.filter(F.arrays_zip(gaps.alias("0"), found.alias("1")), lambda x: x["1"].isNotNull())
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(both), placed), F.lit(0))).otherwise(empty)


def business_number(text: Column, start: Column, length: Column) -> Column:
    """Whether a letter stands before the match, a letter or digit behind it, or a registration label right before it."""
    before = F.substr(text, F.greatest(start - 29, F.lit(1)), F.least(start, F.lit(30)))
    after = F.substr(text, start + length + 1, F.lit(1))
    return before.rlike("[A-Za-z]$") | after.rlike("^[A-Za-z0-9]") | before.rlike(BUSINESS_LABEL)
