"""Queries do the whole job: no word, line or part of a text is left out before the operator."""

import duckdb
import pytest

from leafmill.plans import documents, layout

TEXTS = [(1, "Alpha beta  gamma\n indented Line,of words\n\nbeta"), (2, "one\n" + "\n".join(f"line {i} of many" for i in range(40))), (3, "x" * 70 + " tail\n" + "x" * 70 + " other tail"), (4, ""), (5, "one beginning" + " then more of" + "\none beginning")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in TEXTS], SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def rows(df):
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def whole_sql(folder, sql, *cuts):
    """What a query's SQL gives without the cuts that it makes before the operator."""
    for cut, whole in cuts:
        sql = sql.replace(cut, whole)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rel = c.sql(sql)
    return rel.columns, sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rel.fetchall())


def test_nearest_style_takes_every_word(spark, folder):
    words, lines = layout.words(spark, folder).collect(), layout.text_lines(spark, folder).collect()
    want = []
    for w in words:
        x, y = w.x + w.width / 2, w.y + w.height / 2
        scores = []
        for n in (n for n in lines if n.doc_id == w.doc_id):
            score = abs(y - n.y - n.height / 2) * 4 + abs(x - n.x - n.width / 2) * 0.15
            score += 0 if w.text.lower() in n.text.lower() else 200
            score += 0 if n.y - n.height <= y <= n.y + n.height * 2 else 100
            score += 0 if n.x - n.height <= x <= n.x + n.width + n.height else 50
            scores.append((score, n.line_seq))
        score, line = min(scores)
        want.append((str(w.doc_id), str(w.word_seq), str(line), f"{score:.4f}"))
    assert len(want) == sum(len(t.split()) for _, t in TEXTS)
    assert rows(layout.nearest_style(spark, folder)) == sorted(want)


def test_glyphs_of_every_word(spark, folder):
    got = layout.glyph_split(spark, folder)
    names, want = whole_sql(folder, layout.SQL["glyph_split"], (" WHERE word_seq % 100000 = 0", ""))
    assert rows(got.select(*names)) == want and len(want) == sum(len("".join(t.split())) for _, t in TEXTS)
    lines = {r.doc_id: r for r in layout.glyph_lines(spark, folder).collect()}
    # Each line's words come back with the spaces between them; lines that start further left begin a new one.
    for i, text in TEXTS[1:2]:
        assert lines[i].n == len(text.split("\n")) and lines[i].chars == sum(len(" ".join(n.split())) for n in text.split("\n"))


def test_push_down_folds_every_line(spark, folder):
    want = []
    for i, text in TEXTS:
        cursor = 0.0
        for seq, y in ((k, k * 4.0) for k, n in enumerate(text.split("\n")) if n):
            for top in (5.0, 65.0):
                y = top + 30 if y < top + 20 and y + 12 > top else y
            y = max(y, cursor)
            cursor = y + 16
            want.append((str(i), str(seq), f"{y:.4f}"))
    assert rows(documents.push_down(spark, folder)) == sorted(want)


def test_texts_reach_operators_whole(spark, folder):
    for name, cut in (("doc_headings", "substr(text, 1, 60)"), ("span_merge", "substr(text, 1, 40)")):
        names, want = whole_sql(folder, documents.SQL[name], (cut, "text"))
        assert rows(documents.QUERIES[name](spark, folder).select(*names)) == want
    # Lines 5 units below their first copies replace them only where the whole texts are equal.
    n = [(i, k, t) for i, text in TEXTS for k, t in enumerate(text.split("\n")) if t]
    got = {r.doc_id: r for r in layout.vector_line_merge(spark, folder).collect()}
    assert {i: (r.n, r.n_recovered) for i, r in got.items()} == {i: (sum(x == i for x, _, _ in n), sum(x == i and k % 3 == 0 for x, k, _ in n)) for i in got}
    assert got[5].sum_y == 9.0  # of two lines with one beginning, the first comes again next to the second
    assert got[2].sum_y == sum(k * 4.0 + (5 if k % 3 == 0 else 0) for i, k, _ in n if i == 2)
