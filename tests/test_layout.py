"""Layout folds on literal pages."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import pages as P
from leafmill.operators import tables as B
from leafmill.operators.markdown import markdown_html
from leafmill.plans import layout


def box(x, y, w, h, stroke="#000000", fill=None):
    return {"x": float(x), "y": float(y), "width": float(w), "height": float(h), "stroke": stroke, "fill": fill}


def line(text, x, y, w=30.0, h=12.0):
    return {"text": text, "x": float(x), "y": float(y), "width": w, "height": h, "baseline": float(y)}


def test_chain_means(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 2.0, 4.0, 6.0, 20.0)], "k int, v double")
    assert [r.mean for r in L.chain_clusters(df, ["k"], "v", 3.0).orderBy("cluster").collect()] == [3.0, 20.0]


def test_anchor_groups(spark):
    df = spark.createDataFrame([(1, i, float(y), 0.0) for i, y in enumerate((0, 4, 7, 8, 14))], "k int, line_seq int, y double, x double")
    got = {r.line_seq: r.row for r in L.anchor_groups(df, ["k"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_glyph_widths(spark):
    df = spark.createDataFrame([(1, "Wil", 0.0, 100.0)], "k int, text string, x double, width double")
    assert [round(r.width, 6) for r in L.split_glyphs(df, ["k"]).orderBy("glyph").collect()] == [61.643836, 19.178082, 19.178082]


BOX = "doc int, box_seq int, x double, y double, width double, height double, stroke string, fill string"
LINE = "doc int, line_seq int, text string, x double, y double, width double, height double, baseline double"


def page(spark, boxes, lines, doc=1):
    b = spark.createDataFrame([(doc, i, *b.values()) for i, b in enumerate(boxes)], BOX)
    return b, spark.createDataFrame([(doc, i, *n.values()) for i, n in enumerate(lines)], LINE)


def cells(df):
    return sorted((r.table_seq, r.row, r.col, r.row_span, r.col_span, r.text) for r in df.collect())


def test_stacked_boxes(spark):
    boxes = [box(40, 200, 260, 40), box(40, 240, 260, 40, fill="#EEEEEE"), box(500, 200, 90, 40), box(500, 245, 92, 40), box(40, 300, 260, 40), box(700, 0, 50, 50)]
    lines = [line("CellA", 50, 220), line("CellB", 180, 220), line("CellC", 50, 260), line("more", 52, 265), line("CellD", 180, 260)]
    b, n = page(spark, boxes, lines)
    out = B.stacked_tables(b, n, ["doc"])
    assert cells(out) == [(0, 0, 0, 1, 1, "CellA"), (0, 0, 1, 1, 1, "CellB"), (0, 1, 0, 1, 1, "CellC\nmore"), (0, 1, 1, 1, 1, "CellD")]
    assert {(r.row, r.fill, r.x, r.y, r.width, r.height) for r in out.where("col = 0").collect()} == {(0, None, 40.0, 200.0, 140.0, 40.0), (1, "#EEEEEE", 40.0, 240.0, 140.0, 40.0)}
    assert {(r.table_x, r.table_y, r.table_width, r.table_height) for r in out.collect()} == {(40.0, 200.0, 260.0, 80.0)}


def test_grid_merges_cells_without_rules(spark):
    rules = [box(0, y, 300, 1) for y in (0, 50, 100)] + [box(x, 0, 1, 101) for x in (0, 300)] + [box(150, 0, 1, 51)]
    b, n = page(spark, rules, [line(" low ", 200, 75), line("top", 10, 25), line("er", 200, 85)])
    assert cells(B.ruled_tables(b, n, ["doc"])) == [(0, 0, 0, 1, 1, "top"), (0, 0, 1, 1, 1, ""), (0, 1, 0, 1, 2, "low\ner")]
    assert B.ruled_tables(b.where("box_seq < 5"), n, ["doc"]).count() == 0  # two upright rules only


def test_filled_cells_of_a_grid(spark):
    rules = [box(0, y, 300, 1) for y in (0, 50, 100, 150)] + [box(x, 0, 1, 151) for x in (0, 150, 300)]
    fills = [box(0, 0, 300, 50, fill="#111111"), box(0, 50, 150, 50, fill="#222222"), box(400, 0, 50, 50, fill="#333333")]
    b, n = page(spark, rules + fills, [line("head", 100, 25), line("cell", 20, 75)])
    out = B.ruled_tables(b, n, ["doc"])
    assert cells(out) == [(0, 0, 0, 1, 2, "head"), (0, 1, 0, 1, 1, "cell")]
    assert {(r.fill, r.table_height) for r in out.collect()} == {("#111111", 100.0), ("#222222", 100.0)}  # the last row isn't used


def test_lines_as_table_and_cascade(spark):
    lines = [line("a", 0, 10), line("b", 100, 10), line("c", 200, 10), line("d", 0, 30), line("wide", 100, 30, 140.0), line("f", 0, 50), line("g", 3, 50)]
    b, n = page(spark, [], lines)
    got = B.tables(b, n, ["doc"])
    assert {r.strategy for r in got.collect()} == {"lines"}
    assert cells(got) == [(0, 0, 0, 1, 1, "a"), (0, 0, 1, 1, 1, "b\nc"), (0, 1, 0, 1, 1, "d"), (0, 1, 1, 1, 1, "wide"), (0, 2, 0, 1, 1, "f\ng"), (0, 2, 1, 1, 1, "")]
    wide = B.aligned_tables(n.withColumn("width", F.when(F.col("text") == "d", 196.0).otherwise(F.col("width"))).where("text <> 'wide'"), ["doc"])
    assert (0, 1, 0, 1, 2, "d") in cells(wide) and (0, 1, 1, 1, 1, "") not in cells(wide)
    rules = [box(0, y, 300, 1) for y in (0, 50, 100)] + [box(x, 0, 1, 101) for x in (0, 150, 300)]
    b2, n2 = page(spark, rules, lines, 2)
    stack, few = page(spark, [box(40, 200, 260, 40), box(40, 240, 260, 40)], [line("x", 50, 220)], 3)
    all_ = B.tables(b2.union(stack), n.union(n2).union(few), ["doc"])
    assert {(r.doc, r.strategy) for r in all_.select("doc", "strategy").distinct().collect()} == {(1, "lines"), (2, "grid"), (3, "stacked")}
    assert B.tables(b2.limit(0), n.limit(0), ["doc"]).count() == 0


def test_inferred_boxes_match_a_plain_loop(spark):
    r = random.Random(3)
    rows, want = [], {}
    for doc in range(12):
        y = 0.0
        for _ in range(r.randint(0, 14)):
            y += r.choice((7, 14, 20, 60))
            for x in sorted(r.sample(range(0, 400, 20), r.randint(1, 4))):
                rows.append((doc, len(rows), r.choice(("a", "b", " ")), float(x), y, float(r.choice((10, 15))), float(r.choice((10, 12))), y))
    for doc in range(12):
        groups = {}
        for n in sorted((n for n in rows if n[0] == doc), key=lambda n: (n[4], n[3], n[1])):
            groups.setdefault(next((g for g in groups if abs(g - n[4]) <= 6), n[4]), []).append(n)
        lines = sorted((sorted(g, key=lambda n: n[3]) for g in groups.values() if any(n[2].strip() for n in g)), key=lambda g: g[0][4])
        i, n_boxes, area = 0, 0, 0.0
        while i < len(lines):
            tall = max(n[6] for n in lines[i])
            view = lines[i : i + 8]
            near = view[:1] + [b for a, b in zip(view, view[1:]) if 0 < b[0][4] - a[0][4] < 3.2 * tall]
            if len(lines[i]) > 1 and len(near) > 1:
                left = max(0, lines[i][0][3] - max(5, 0.35 * tall))
                right = max(n[3] + n[5] for g in near for n in g) + max(5, 0.35 * tall)
                top = max(0, near[0][0][4] - max(4, 0.25 * tall))
                low = max(n[4] + n[6] for n in near[-1]) + max(4, 0.25 * tall)
                n_boxes += len(near) * len(lines[i])
                area += (right - left) * (low - top)
                i += len(near) - 1
            i += 1
        want[doc] = (n_boxes, round(area, 4))
    out = B.inferred_boxes(spark.createDataFrame(rows, LINE), ["doc"]).collect()
    for doc in range(12):
        mine = [x for x in out if x.doc == doc]
        assert sorted(x.box_seq for x in mine) == list(range(len(mine)))
        assert (len(mine), round(sum(x.width * x.height for x in mine), 4)) == want[doc]


def test_recovered_line_replaces_its_twin(spark):
    schema = "doc int, seq int, text string, x double, y double, width double, height double"
    a = spark.createDataFrame([(1, 0, "Total", 10.0, 10.0, 30.0, 10.0), (1, 1, "Other", 10.0, 40.0, 30.0, 10.0)], schema)
    r = spark.createDataFrame([(1, 0, "total ", 12.0, 11.0, 30.0, 10.0), (1, 1, "other", 300.0, 40.0, 30.0, 10.0)], schema)
    got = [(x.text, x.recovered) for x in L.merge_recovered(a, r, ["doc"]).orderBy("line_seq").collect()]
    assert got == [("Other", False), ("total ", True), ("other", True)]


def test_glyphs_become_lines(spark):
    glyphs = [(1, i, float(x), 0.0, 10.0, c, "s") for i, (c, x) in enumerate(zip("APPLYNOW", (0, 6, 12, 18, 24, 40, 46, 52)))]
    df = spark.createDataFrame(glyphs, "doc int, seq int, x double, y double, font_size double, content string, style string")
    assert [r.text for r in L.glyph_lines(df, ["doc"]).collect()] == ["APPLY NOW"]


@pytest.mark.parametrize("n, parts, sizes", [(10, 3, [4, 4, 2]), (10, 4, [3, 3, 3, 1]), (3, 5, [1, 1, 1])])
def test_split_counts(spark, n, parts, sizes):
    df = spark.createDataFrame([(1, i) for i in range(n)], "doc_id int, page_index int")
    assert [r["count"] for r in P.split_by_count(df, parts).groupBy("part").count().orderBy("part").collect()] == sizes


def test_ranges():
    assert P.parse_ranges("1-3, 5, 8-10", 10) == [(1, 3), (5, 5), (8, 10)]
    for bad in ("5-2", "0", "11", "", "a"):
        with pytest.raises(ValueError):
            P.parse_ranges(bad, 10)


def test_markdown_blocks(spark):
    cases = {
        "# T\n- a\n- b\n\n1. x\n> q\n```py\n<i>\n```": '<h1>T</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n\n<ol>\n<li>x</li>\n</ol>\n<blockquote>q</blockquote>\n<pre><code class="language-py">\n&lt;i&gt;\n</code></pre>',
        "| a | b |\n|---|---|\n# h\nend": "<h1>h</h1>\n<table><tr><td>a</td><td>b</td></tr></table>\n<p>end</p>",
        "- a\n1. b\n2.5 c\n```\nx": "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n<p>2.5 c</p>\n<pre><code>\nx\n</code></pre>\n</ol>",
        "|a|\n- b": "<table><tr><td>a</td></tr></table>\n<ul>\n<li>b</li>\n</ul>",
        "|a|\n***\n|b|": "<hr>\n<table><tr><td>a</td></tr><tr><td>b</td></tr></table>",
        "|": "",
        "": "",
        " **x** _y_ ": "<p><strong>x</strong> <em>y</em></p>",
    }
    df = spark.createDataFrame([*enumerate(cases), (99, None)], "k int, text string")
    assert {r.k: r.html for r in markdown_html(df, ["k"]).collect()} == dict(enumerate(cases.values())) | {99: ""}


def test_equal_values_are_one_cluster(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 1.0, 200.0, 200.0, 200.0, 201.0) * 20], "k int, v double").repartition(7)
    assert sorted((r.cluster, r.n) for r in L.chain_clusters(df, ["k"], "v", 150.0).collect()) == [(0, 40), (1, 80)]


def test_unknown_values_come_last_as_in_the_sql(spark, tmp_path):
    rows = [(k, v) for k in (1, None) for v in (1000.0, None, 10.0, None, 100.0, float("nan"), 10.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = layout.cluster_chain(spark, str(tmp_path)).select("l_suppkey", "cluster", "total", "n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, c.sql(layout.SQL["cluster_chain"]).fetchall())) and len(got) == 10
