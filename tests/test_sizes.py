"""Work that grows with the input only: parts of bounded size, no repeated evaluation, no sorts of glyphs."""

import io
import random
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import documents as D
from leafmill.operators import layout as L
from leafmill.operators import personal_data as P
from leafmill.operators.markdown import markdown_html
from leafmill.plans import documents, layout, styles
from leafmill.plans import markup as markup_plans
from leafmill.sources import archives, markup
from leafmill.sources.tables import in_parts
from leafmill.streaming import lifetimes

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_texts(spark):
    docs = spark.range(400).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    parts = in_parts(docs, "id", "text", 4000)
    assert parts.rdd.getNumPartitions() == 11 and parts.count() == 400
    assert parts.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 100
    assert in_parts(docs.limit(0), "id", "text").rdd.getNumPartitions() == 1


def test_only_points_in_reach_are_placed(spark):
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 20.0), (1, 1, 0.0, 0.0, 500.0, 200.0), (2, 0, 900.0, 0.0, 50.0, 20.0)], "p int, cell_seq int, x double, y double, width double, height double")
    glyphs = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 400.0, 10.0), (1, 2, 9000.0, 10.0), (2, 0, 10.0, 10.0), (3, 0, 10.0, 10.0)], "p int, glyph_seq int, x double, y double")
    tiled, _ = L._tiled(cells, (1.0, 40.0))
    reached = L._in_reach(glyphs, tiled, ["p"], (F.col("x"), F.col("y")), (1.0, 40.0))
    assert sorted((r.p, r.glyph_seq) for r in reached.collect()) == [(1, 0), (1, 0), (1, 1)]
    assert sorted(tuple(r) for r in L.smallest_cell(glyphs, cells, ["p"]).collect()) == [(1, 0, 0), (1, 1, 1)]


def test_glyphs_are_not_sorted(spark):
    words = spark.createDataFrame([(1, "Wi😀é", 6.0, 24.0), (2, "", 0.0, 6.0), (3, None, 0.0, 6.0), (4, "a", None, 6.0)], "k int, text string, x double, width double")
    out = L.split_glyphs(words, ["k"])
    assert "Window" not in plan(out) and "Sort" not in plan(out)
    got = sorted((r.k, r.glyph, r.text, r.x and round(r.x, 6), r.width and round(r.width, 6)) for r in out.collect())
    total = 0.9 + 0.28 + 1 + 1
    assert got == [(1, 0, "W", 6.0, round(24 * 0.9 / total, 6)), (1, 1, "i", round(6 + 24 * 0.9 / total, 6), round(24 * 0.28 / total, 6)), (1, 2, "😀", round(6 + 24 * 1.18 / total, 6), round(24 / total, 6)), (1, 3, "é", round(6 + 24 * 2.18 / total, 6), round(24 / total, 6)), (4, 0, "a", None, None)]


def test_runs_with_cells_and_styles(spark):
    glyphs = [(1, 0, 0.0, "A", "s", 7), (1, 1, -50.0, "B", "t", 7), (1, 2, 6.0, "C", "s", None), (1, 3, 12.0, "D", "t", None), (1, 4, 18.0, None, "t", None), (1, 5, 0.0, "E", "t", None)]
    df = spark.createDataFrame([(*g[:3], 0.0, 10.0, *g[3:]) for g in glyphs], "doc int, seq int, x double, y double, font_size double, content string, style string, cell int")
    assert [(r.line_seq, r.x, r.text) for r in L.glyph_lines(df, ["doc"]).orderBy("line_seq").collect()] == [(0, 0.0, "ABC"), (1, 12.0, "D"), (2, 0.0, "E")]


def test_texts_are_searched_once(spark):
    df = spark.createDataFrame([('<a x="1" y="2" x="3">&#65;&amp;#x42;',), (None,)], "s string")
    found = df.select(X.attributes(F.col("s")).alias("a"), X.normal_word(F.col("s")).alias("t"))
    assert [tuple(r) for r in found.collect()] == [({"y": "2", "x": "3"}, "AB"), ({}, None)]
    assert plan(found).count("regexp_extract_all") == 4


def test_styles_are_made_once_in_many_tasks(spark):
    assert plan(styles.style_css(spark, DIR)).count("shadeColor") < 8 and "Exchange" in plan(styles.style_css(spark, DIR))


class _Store:
    """A map or value state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*a):
            self.calls += 1
            return {"containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}), "exists": lambda: 0 in self.held, "get": lambda: self.held[0], "update": lambda v: self.held.update({0: v}), "clear": lambda: self.held.clear()}[name](*a)

        return call


def test_state_is_written_once_a_batch():
    rows = [Row(at=i, seq=i, kind=k, value=float(i)) for i, k in enumerate(["start", *["progress"] * 99])]
    quota, jobs, sessions = lifetimes.Quota(), lifetimes.Jobs(), lifetimes.Sessions()
    quota.days, jobs.job, sessions.live = stores = [_Store() for _ in range(3)]
    for p in (quota, jobs, sessions):
        p.handle = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    assert [r.n for r in quota.handleInputRows((1,), iter(rows), None)] == [*range(1, 101)]
    assert [r.progress for r in jobs.handleInputRows((1,), iter(rows), None)] == [float(i) for i in range(100)]
    renewed = [Row(at=i, seq=i, kind="create") for i in range(50)]
    assert len(list(sessions.handleInputRows((1,), iter(renewed), None))) == 99
    assert all(s.calls <= 3 for s in stores)
    list(sessions.handleInputRows((1,), iter([Row(at=60, seq=60, kind="delete")]), None))
    assert sessions.live.held == {}


def test_words_meet_lines_without_stored_pairs(spark, monkeypatch):
    box = "x double, y double, width double, height double"
    words = [(p, i, t, x, float(i * 9 % 70), 12.0, 12.0) for p in (1, 2) for i, (t, x) in enumerate([("Ab", 0.0), ("cd", 50.0), (None, 5.0), ("Ab", 300.0), ("q", None), ("é", 7.0)])]
    lines = [(p, i, t, float(i % 3 * 40), i * 11.0, 90.0, 12.0) for p in (1, 3) for i, t in enumerate(["xab", "CD cd", None, "É", "xab", ""])]
    w, n = spark.createDataFrame(words, f"p int, word_seq bigint, text string, {box}"), spark.createDataFrame(lines, f"p int, line_seq int, text string, {box}")
    pairs = n.alias("n").withColumn("_low", F.lower("text")).alias("n").join(w.withColumn("_low", F.lower("text")).alias("w"), "p").select("p", "word_seq", "line_seq", L._style_score("w", "n").alias("score"))
    want = pairs.groupBy("p", "word_seq").agg(F.min(F.struct(F.col("score").isNull(), "score", "line_seq")).alias("s")).select("p", "word_seq", "s.line_seq", "s.score")
    monkeypatch.setattr(L, "PAIRS", 7)
    got = L.nearest_style(w, n, ["p"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 6
    assert "FlatMapCoGroupsInArrow" in plan(got) and "Join" not in plan(got)


def test_wide_grids_are_folded_by_rows(spark):
    r, rows, cols = random.Random(3), 250, 100
    cells = [(1, y, x, r.choice([1, 1, 1, 2, 3]), r.choice([0, 1, 1, 1, 2])) for y in range(rows) for x in range(cols) if r.random() < 0.9]
    taken, want = set(), []
    for k, y, x, wide, tall in sorted(cells):
        if (y, x) not in taken:
            want.append((k, y, x))
            taken |= {(y + i, x + j) for i in range(tall) for j in range(wide)}
    df = spark.createDataFrame([(k, y, x, tall, wide) for k, y, x, wide, tall in cells], "k int, row int, col int, row_span int, col_span int")
    start = time.monotonic()
    assert sorted((c.k, c.row, c.col) for c in D.visible_cells(df, ["k"]).collect()) == want
    assert time.monotonic() - start < 20  # every cell against all before it: 280 million comparisons


def test_headings_take_one_grouping(spark):
    lines = [(1, 0, 0.0, "ab"), (1, 1, 30.0, " "), (1, 2, 60.0, "abc "), (1, 3, 90.0, "xyz"), (2, 0, 0.0, "one"), (2, 1, 50.0, "one")]
    out = D.headings(spark.createDataFrame([(*n[:2], 0.0, *n[2:]) for n in lines], "page int, line_seq int, x double, y double, text string"), ["page"])
    assert sorted(map(tuple, out.collect())) == [(1, "abc", "ab"), (2, "one", None)]
    assert "MergeJoin" not in plan(out) and "HashJoin" not in plan(out) and plan(documents.doc_headings(spark, DIR)).count("Exchange ") == 1


def test_unpacked_files_share_batches(monkeypatch):
    held = SimpleNamespace(mapInPandas=lambda run, schema: run)
    run = archives.unpacked(SimpleNamespace(select=lambda *c: held), "hwpx")
    files = pd.DataFrame({"path": [str(i) for i in range(300)], "content": [b"broken"] * 300})
    assert [len(part) for part in run(iter([files]))] == [300]
    monkeypatch.setattr(archives, "CHARS", 10)
    out = io.BytesIO()
    with archives.zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", "<s><p><t>twelve chars</t></p></s>")
    whole = [part["text"].tolist() for part in run(iter([files.assign(content=out.getvalue()).head(3)]))]
    assert sum(whole, []) == ["twelve chars"] * 3 and max(map(len, whole)) == 1


def test_rects_are_read_once_in_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(1, '<rect x="1" width="0" height="2"/><RECT width="2" width="3" height="q" height="4" fill="#a"/>'), (2, "")], "k int, svg string")
    out = markup.svg_rects(df, ["k"])
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0.0, 0.0, 3.0, 4.0, 0.0, "#a", None)]
    assert plan(out).count("regexp_extract_all") == 3
    monkeypatch.setattr(markup_plans, "PART", 2000)
    assert markup_plans.svgs(spark, DIR).rdd.getNumPartitions() > 2


def test_markdown_is_one_pass_over_parts_of_bounded_size(spark):
    docs = in_parts(spark.createDataFrame([(1, "|a|\n# h\nx\n|b|"), (2, "```\n|c|"), (3, "- a\n|d|\n- b\n|e|"), (4, "")], "k int, text string"), "k", "text", 5)
    out = markdown_html(docs, ["k"])
    got = {r.k: r.html for r in out.collect()}
    row = "<tr><td>{}</td></tr>".format
    assert got == {
        1: f"<h1>h</h1>\n<table>{row('a')}</table>\n<p>x</p>\n<table>{row('b')}</table>", 2: "<pre><code>\n|c|\n</code></pre>",
        3: f"<ul>\n<li>a</li>\n</ul>\n<table>{row('d')}</table>\n<ul>\n<li>b</li>\n</ul>\n<table>{row('e')}</table>", 4: "",
    }
    assert plan(markdown_html(docs, ["k"])).count("Generate posexplode") == 1
    assert plan(markup_plans.markdown_pages(spark, DIR)).count("Generate posexplode") == 1


def test_ends_are_trimmed_without_a_pattern(spark):
    df = spark.createDataFrame([("　\t a  b ﻿\n",), (" \n",), ("a\u0085",), (None,)], "s string")
    out = df.select(X.trim_ws(F.col("s")).alias("t"))
    assert [r.t for r in out.collect()] == ["a  b", "", "a\u0085", None] and "regexp" not in plan(out)


def test_pages_are_searched_once(spark):
    items = spark.createDataFrame([(1, 0, "a.b@c", 30.0), (1, 1, ".org", 24.0), (2, 0, "nothing", 42.0)], "p int, item_seq int, str string, width double")
    items = items.withColumn("transform", F.array(*map(F.lit, (12.0, 0.0, 0.0, 12.0, 0.0, 5.0)))).withColumn("height", F.lit(12.0))
    out = P.detect_positioned(items, ["p"], shown=P.KINDS)
    assert [(r.p, r.type, r.text) for r in out.collect()] == [(1, "email", "a.b@c.org")]
    filters = [n for n in plan(out).splitlines() if " Filter " in n]
    assert not any("regexp" in n for n in filters)


def _text_lines(spark):
    r = random.Random(7)
    rows = [(p, i, " ".join(r.choice(["Wi,", "é😀;", "a", "to:", "MMll", "", ",", "  b"]) for _ in range(r.randint(0, 30))), i * 14.0, r.choice([10.0, 12.0]), r.choice(["s", "s", "t", None])) for p in (1, 2, 3) for i in range(25)]
    rows += [(4, 0, None, 0.0, 12.0, "s"), (5, 0, " ", 0.0, 12.0, "s"), (6, 0, "", 0.0, 12.0, "s")]
    r.shuffle(rows)
    words, lines = [], "p int, line_seq int, text string, y double, height double, style string"
    for p, i, t, *more in rows:
        at = 0
        for j, w in enumerate((t or "").split(" ")):
            words += [(p, (i << 32) + j, w, at * 6.0, len(w) * 6.0, *more)] if w else []
            at += len(w) + 1
    return spark.createDataFrame(rows, lines), spark.createDataFrame(words, "p int, word_seq bigint, text string, x double, width double, y double, height double, style string")


def test_lines_of_text_are_respaced_without_stored_glyphs(spark):
    lines, words = _text_lines(spark)
    out = L.respaced_lines(lines, ["p"], "style", 6.0)
    glyphs = L.split_glyphs(words, ["p", "word_seq", "y", "height", "style"]).withColumn("x", F.round(F.col("x") + 1e-9, 4)).withColumnsRenamed({"height": "font_size", "text": "content"})
    want = L.glyph_lines(glyphs, ["p"], ["word_seq", "glyph"])
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60
    # Texts are dealt once and counts once; glyphs never are.
    query = plan(layout.glyph_lines(spark, "/root/testdata/sf0.01"))
    assert query.count("Exchange ") == 2 and query.count("Sort ") == 1 and "Window" not in query


def test_glyphs_of_texts_take_no_exchange(spark, monkeypatch, tmp_path):
    lines, words = _text_lines(spark)
    want = sorted(map(tuple, L.split_glyphs(words, ["p", "word_seq"]).collect()))
    for size in (1 << 20, 50):
        monkeypatch.setattr(L, "GLYPHS", size)
        monkeypatch.setattr(L, "WORDS", size)
        out = L.text_glyphs(lines.coalesce(1), ["p"], 6.0)
        assert sorted(map(tuple, out.collect())) == want
        assert all(f" {n}" not in plan(out) for n in ("Window", "Sort", "Exchange"))
    monkeypatch.undo()
    x = [(r.p, r.word_seq) for r in L.text_glyphs(lines.coalesce(1), ["p"], 6.0).where("glyph = 0").collect()]
    place = {(r.p, r.word_seq): (r.width, r.x) for r in words.collect()}
    assert [place[w] for w in x] == sorted(place.values())
    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in plan(layout.glyph_split(spark, str(tmp_path))) and "Window" not in plan(layout.glyph_split(spark, DIR))
