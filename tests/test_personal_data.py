"""Literal cases and invariants of personal-data detection."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import masking as M
from leafmill.operators import personal_data as P
from pyspark.sql import functions as F

SPACED = "주민번호 9 0 0 1 0 1 - 1 2 3 4 5 6 7 연락처 0 3 2 - 5 4 0 - 5 6 4 1"


def preview(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.type, r.text, r.masked_text, r.verified) for r in P.detect_preview(df, ["doc_id"]).orderBy("text").collect()]


def items(text):
    """One item for each character, 8 wide, spaces 4."""
    out, x = [], 0.0
    for i, c in enumerate(text):
        w = 4.0 if c == " " else 8.0
        out.append((1, 0, i, c, [12.0, 0.0, 0.0, 12.0, x, 100.0], w, 12.0))
        x += w
    return out


ITEMS = "doc_id long, page_index int, item_seq int, str string, transform array<double>, width double, height double"


def positioned(spark, text, shown=P.KINDS):
    df = P.detect_positioned(spark.createDataFrame(items(text), ITEMS), ["doc_id", "page_index"], shown=shown)
    return [(r.type, r.text, r.width > 0 and r.height > 0) for r in df.orderBy("seq").collect()]


def test_preview_spaced(spark):
    got = preview(spark, SPACED)
    assert {(t, x) for t, x, _, _ in got} >= {("rrn", "900101-1234567"), ("phone", "032-540-5641")}
    assert next(v for t, _, _, v in got if t == "rrn") is False


def test_positioned_spaced(spark):
    assert positioned(spark, SPACED)[:2] == [("rrn", "900101-1234567", True), ("phone", "032-540-5641", True)]


def test_business_number(spark):
    text = "구직등록번호 K 1 5 0 1 1 2 6 0 5 1 3 0 1 3 6"
    assert not [x for x in preview(spark, text) if x[0] == "rrn"]
    assert not [x for x in positioned(spark, text) if x[0] in ("rrn", "phone")]


def test_date_is_no_account(spark):
    assert not [x for x in positioned(spark, "발급일시 2026-05-22 17:53:39") if x[0] == "account"]


def test_card(spark):
    got = preview(spark, "4111-1111-1111-1111")
    assert ("card", "4111-1111-1111-1111", "4111-****-****-1111", True) in got
    assert ("account", "4111-1111-1111-111", "4111-1111-1111-****", None) in got
    assert preview(spark, "4111111111111111")[0][:3] == ("card", "4111111111111111", "4111111111111111")
    assert not [x for x in preview(spark, "1234-5678-9012-3456") if x[0] == "card"]


@pytest.mark.parametrize("text, kind", [("tel 010-1234-5678", "account")])
def test_suppressed_phone_is_an_account(spark, text, kind):
    assert [x[0] for x in preview(spark, text)] == [kind]


def test_masks(spark):
    rows = [("010-1234-5678",), ("01012345678",), ("032-540-5641",), ("02-123-4567",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(M.mask_phone(F.col("s"))).collect()] == ["010-****-5678", "010-****-5678", "032-540-****", "02-123-****"]
    df = spark.createDataFrame([("hong@example.com",), ("abc@x.kr",), ("ab@x.kr",), ("a@x.kr",)], "s string")
    assert [r[0] for r in df.select(M.mask_email(F.col("s"))).collect()] == ["h**g@example.com", "a*c@x.kr", "a***@x.kr", "a***@x.kr"]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.kr")], "doc_id long, text string")
    assert [(r.doc_id, r.type) for r in P.detect_preview(df, ["doc_id"]).collect()] == [(None, "email")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[a-z]{3,12}@[a-z]{2,6}\.kr", fullmatch=True), min_size=1, max_size=20))
def test_long_addresses_keep_their_length(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert all(len(r.s) == len(r.m) for r in df.select("s", M.mask_email(F.col("s")).alias("m")).collect())
