"""The layout data source, and the banded search for the nearest line."""

import random

from pyspark.sql import functions as F

from leafmill.operators import layout
from leafmill.sources import layout_files as L


def test_parts_come_back_and_filters_leave_files_out(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 100).cast("int").alias("page_index"), F.lit(0).alias("line_seq"), F.concat(F.lit('é "x"\n'), F.col("id")).alias("text"), (F.col("id") * 1.5).alias("x"), F.lit(True).alias("bold"), F.lit(1).alias("unknown"))
    path = str(tmp_path / "l")
    L.write_part(rows, path, "lines")
    L.write_part(rows.where("false"), path, "cells")
    df = L.read_part(spark, path, "lines")
    assert df.columns == spark.createDataFrame([], L.PARTS["lines"]).columns
    known = ["doc_id", "page_index", "line_seq", "text", "x", "bold"]
    assert df.select(known).exceptAll(rows.select(known)).isEmpty() and df.count() == 2000
    for condition in ("page_index = 5", "page_index in (3, 70)", "page_index > 20 and page_index <= 40 and doc_id < 500", "page_index < 0"):
        assert df.where(condition).count() == rows.where(condition).count()
    assert [L.read_part(spark, path, part).count() for part in ("cells", "boxes")] == [0, 0]
    schema = spark.createDataFrame([], L.PARTS["lines"]).schema
    everything = L.LayoutReader(path, "lines", schema)
    one = L.LayoutReader(path, "lines", schema)
    assert one.pushFilters([L.EqualTo(("page_index",), 17), L.EqualTo(("doc_id",), 1)]) and {p.path.split("span=")[1][0] for p in one.partitions()} == {"1"}
    size = lambda r: sum(p.end - p.start for p in r.partitions())
    assert size(one) < size(everything) / 4
    assert len({p.path.split("span=")[1][0] for p in everything.partitions()}) == 7


def test_pieces_of_files_meet_without_loss(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_index"), F.repeat(F.lit("ab"), (F.col("id") % 90).cast("int")).alias("text"))
    L.write_part(rows.coalesce(1), str(tmp_path), "lines")
    schema = spark.createDataFrame([], L.PARTS["lines"]).schema
    for size in (1, 37, 1000, 1 << 20):
        reader = L.LayoutReader(str(tmp_path), "lines", schema, size)
        got = [x for p in reader.partitions() for batch in reader.read(p) for x in batch.column("doc_id").to_pylist()]
        assert sorted(got) == list(range(300))


def plain_score(w, n):
    cx, cy, (x, y, wide, high) = w["x"] + w["width"] / 2, w["y"] + w["height"] / 2, (n[k] for k in ("x", "y", "width", "height"))
    s = abs(cy - (y + high / 2)) * 4 + abs(cx - (x + wide / 2)) * 0.15
    return s + (0 if w["text"].lower() in n["text"].lower() else 200) + (0 if y - high <= cy <= y + 2 * high else 100) + (0 if x - high <= cx <= x + wide + high else 50)


BOX = "page int, {}_seq int, text string, x double, y double, width double, height double"


def test_bands_find_what_all_pairs_find(spark):
    r = random.Random(4)
    box = lambda: (r.choice("abcAB") * r.randrange(3), r.choice([0.0, r.uniform(-50, 900)]), r.choice([r.uniform(-90, 700), 14.0 * r.randrange(9)]), r.uniform(0, 400), r.choice([0.0, 12.0, 60.0]))
    lines = [(p, i, *box()) for p in range(5) for i in range((1, 3, 40, 80, 0)[p])]
    words = [(p, i, *box()) for p in range(5) for i in range(40)]
    wd, ld = spark.createDataFrame(words, BOX.format("word")), spark.createDataFrame(lines, BOX.format("line"))
    got = {(x.page, x.word_seq): (x.line_seq, round(x.score, 6)) for x in layout.nearest_style(wd, ld, ["page"]).collect()}
    want = {}
    for w in wd.collect():
        pairs = [(plain_score(w, n), n.line_seq) for n in ld.collect() if n.page == w.page]
        if pairs:
            want[w.page, w.word_seq] = (min(pairs)[1], round(min(pairs)[0], 6))
    assert got == want


def test_long_pages_are_not_searched_as_a_whole(spark):
    text = " ".join(f"w{i}" for i in range(12))
    lines = [(1, i, text, 0.0, 14.0 * i, 6.0 * len(text), 12.0) for i in range(400)]
    words = [(1, i * 12 + k, f"w{k}", 6.0 * text.index(f"w{k}"), 14.0 * i, 12.0, 12.0) for i in range(400) for k in range(12)]
    ld = spark.createDataFrame(lines, BOX.format("line"))
    best, more = layout.style_candidates(spark.createDataFrame(words, BOX.format("word")), ld, ["page"])
    assert best.count() == len(words)
    # A word looks at four lines at first, and a few need more.
    assert more.count() + 4 * len(words) < 0.05 * len(words) * len(lines)


def test_tiles_find_what_all_pairs_find(spark):
    r = random.Random(9)
    side = lambda: r.choice([0.0, r.uniform(0, 30), r.uniform(0, 500), 3000.0, 64.0])
    at = lambda: r.choice([r.uniform(-300, 900), 64.0 * r.randrange(-2, 6)])
    lines = [(p, i, at(), at(), 2.0, 4.0) for p in range(3) for i in range(60)]
    boxes = [(p, i, at(), at(), side(), side()) for p in range(2) for i in range(25)]
    kind = "page int, {} int, x double, y double, width double, height double"
    ld, bd = spark.createDataFrame(lines, kind.format("n")), spark.createDataFrame(boxes, kind.format("b"))
    held = lambda n, b: n[0] == b[0] and b[2] - 1 <= n[2] + n[4] / 2 <= b[2] + b[4] + 1 and b[3] - 1 <= n[3] + n[5] / 2 <= b[3] + b[5] + 1
    pairs = sorted((n[0], n[1], b[1]) for n in lines for b in boxes if held(n, b))
    assert sorted((x.page, x.n, x.box_b) for x in layout.inside(ld, bd, ["page"]).collect()) == pairs
    some = {p[:2] for p in pairs}
    assert sorted((x.page, x.n) for x in layout.inside(ld, bd, ["page"], how="left_semi").collect()) == sorted(some)
    assert sorted((x.page, x.n) for x in layout.inside(ld, bd, ["page"], how="left_anti").collect()) == sorted({n[:2] for n in lines} - some)
    near = {}
    for n in lines:
        fits = [(b[4] * b[5], b[1]) for b in boxes if n[0] == b[0] and b[2] - 1 <= n[2] <= b[2] + b[4] + 1 and b[3] - 40 <= n[3] <= b[3] + b[5] + 40]
        if fits:
            near[n[:2]] = min(fits)[1]
    got = layout.smallest_cell(ld.withColumnRenamed("n", "glyph_seq"), bd.withColumnRenamed("b", "cell_seq"), ["page"])
    assert {(x.page, x.glyph_seq): x.cell_seq for x in got.collect()} == near
    assert layout.inside(ld, bd.limit(0), ["page"]).isEmpty() and layout.inside(ld, bd.limit(0), ["page"], how="left_anti").count() == len(lines)
