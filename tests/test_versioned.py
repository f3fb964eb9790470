"""Stores that are changed in place, and functions over hand-checked values."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.sources import versioned as V

KIND = "k string, seq long, v string"


def rows(spark, *items):
    return spark.createDataFrame(items, KIND + ", gone boolean")


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "s")
    held = lambda: {r.k: (r.seq, r.v) for r in V.read_store(spark, root, KIND).collect()}
    assert held() == {}
    assert V.upsert(rows(spark, ("a", 1, "x", False), ("b", 1, "y", False), (None, 1, "n", False), ("a", 2, "z", False)), root, "k", "seq", "gone") == 1
    assert held() == {"a": (2, "z"), "b": (1, "y"), None: (1, "n")}
    change = rows(spark, ("b", 2, None, True), ("a", 1, "late", False))
    assert V.upsert(change, root, "k", "seq", "gone") == 2 and held() == {"a": (2, "z"), None: (1, "n")}
    assert V.upsert(change, root, "k", "seq", "gone") == 3 and held() == {"a": (2, "z"), None: (1, "n")}
    assert len(list((tmp_path / "s" / "v=2").glob("bucket=*"))) <= 2
    assert V.upsert(rows(spark, ("b", 3, "back", False)), root, "k", "seq", "gone") == 4 and held()["b"] == (3, "back")
    assert V.upsert(rows(spark).limit(0), root, "k", "seq", "gone") == 4


def test_a_failed_write_leaves_the_last_state(spark, tmp_path):
    root = str(tmp_path / "s")
    V.upsert(rows(spark, ("a", 1, "x", False)), root, "k", "seq", "gone")
    bad = rows(spark, ("a", 2, "y", False)).withColumn("v", F.when(F.col("seq") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        V.upsert(bad, root, "k", "seq", "gone")
    assert [tuple(r) for r in V.read_store(spark, root, KIND).collect()] == [("a", 1, "x")]
    (tmp_path / "s" / "v=2" / "bucket=0").mkdir(parents=True, exist_ok=True)  # what an interrupted job leaves
    (tmp_path / "s" / "v=2" / "bucket=0" / "part-0.json").write_text('{"k": "q", "seq": 9, "v": "half"}')
    assert [tuple(r) for r in V.read_store(spark, root, KIND).collect()] == [("a", 1, "x")]
    assert V.upsert(rows(spark, ("b", 1, "y", False)), root, "k", "seq", "gone") == 2
    assert {r.k for r in V.read_store(spark, root, KIND).collect()} == {"a", "b"}


CASES = [
    (X.markdown_inline, [("**a** and _b_", "<strong>a</strong> and <em>b</em>"), ("![x](y.png) [l](u)", '<img src="y.png" alt="x"> <a href="u">l</a>'), ("`c` __d__ *e*", "<code>c</code> <strong>d</strong> <em>e</em>"), ("snake_case_name", "snake<em>case</em>name")]),
    (X.decode_entities, [("a&lt;b&gt;", "a<b>"), ("x<br/>y<b>z</b>", "x\nyz"), ("&amp;#65;", "A"), ("&#x41;&#66;c", "ABc"), ("&amp;lt;", "&lt;"), ("&#54620;&#xAE00;", "한글")]),
    (X.decode_odf, [('a<text:s text:c="3"/>b', "a   b"), ("a<text:tab/>b<text:s/>c", "a\tb c"), (" x <text:line-break/>  y ", "x\ny")]),
    (X.odf_px, [("1in", 96.0), ("2.54cm", 96.0), ("72pt", 96.0), ("10", 10.0), ("8px", 8.0), ("abc", 0.0), ("-1.5in", -144.0)]),
    (X.odf_pt, [("1in", 72.0), ("2.54cm", 72.0), ("72pt", 72.0), ("8px", 6.0), ("abc", 12.0)]),
    (X.normal_path, [("a/b/../c.png", "a/c.png"), ("./x//y.SVG", "x/y.SVG"), ("../../q", "q")]),
    (X.mime_type, [("c.png", "image/png"), ("y.SVG", "image/svg+xml"), ("q", None)]),
    (X.without_extension, [("f.tar.gz", "f.tar"), ("../../q", "../.")]),
    (X.normal_font, [("ABCDEF+Arial-Bold", "Nimbus Sans"), ("HCR Batang", "Batang"), ("맑은 고딕", "Malgun Gothic"), ("", "함초롬바탕"), ("Noto Sans CJK", "Noto Sans CJK KR"), ("X+Foo", "Foo"), ("TimesNewRoman", "Nimbus Roman"), ("Courier", "Nimbus Mono PS")]),
    (lambda s: X.sanitize_line(s, 80), [("  a \t b  ", "a b"), ("x\r\ny", "x y"), ("", "")]),
    (lambda s: X.sanitize_message(s, 80), [("  a \t b  ", "a \t b"), ("x\r\ny", "x\ny")]),
    (lambda s: X.cookies(s)["b"], [("a=1; b=x=y", "x=y"), ("sid=abc", None)]),
    (X.colour_of_int, [("0", "#000000"), ("16711680", "#FF0000"), ("3368601", "#336699")]),
]


@pytest.mark.parametrize("function, cases", CASES)
def test_hand_checked_values(spark, function, cases):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(function(F.col("s"))).collect()]
    assert [round(x, 6) if isinstance(x, float) else x for x in got] == [b for _, b in cases]
