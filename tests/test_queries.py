"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from parley.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(str(dict(zip(names, row))[c]) for c in cols) for row in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_lanes_never_overlap(spark):
    days: dict = {}
    for r in QUERIES["week_lanes"](spark, SF).collect():
        days.setdefault((r["meeting_date"], r["lane"]), []).append((r["start_min"], r["end_min"]))
    for spans in days.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
