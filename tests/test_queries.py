"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in rows)


OWN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert plain(rows) == plain(duck.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "id", "score", "pos"] or entry.entry(spark).count() > 0
