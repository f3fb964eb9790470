"""Every registered query outside the llm subpackage against its SQL in DuckDB, at sf0.001."""

import duckdb
import pytest

from leafmill.plans import accounts, documents, drawing, layout, markdown, markup, personal_data, streams, structured, styles, text

FAMILIES = (personal_data, accounts, text, layout, drawing, documents, markup, markdown, structured, styles, streams)
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, int):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name, query, sql", [(n, q, f.SQL[n]) for f in FAMILIES for n, q in f.QUERIES.items() if n in f.SQL])
def test_matches_sql(spark, duck, name, query, sql):
    df = query(spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
