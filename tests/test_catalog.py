"""Every query of the catalog against its SQL on the smallest tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from packspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLES)))
def test_against_sql(spark, duck, name):
    want = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    shape = lambda rows: sorted(([plain(v) for v in r] for r in rows), key=str)
    assert shape(got.select(*want.columns).collect()) == shape(want.fetchall())


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    first = __spark_entry__.entry(spark)
    rows = first.collect()
    assert rows and first.columns[:3] == ["query_id", "pos", "path"]
    for q in {r["query_id"] for r in rows}:
        mine = [r for r in rows if r["query_id"] == q]
        assert [r["pos"] for r in sorted(mine, key=lambda r: r["pos"])] == list(range(1, len(mine) + 1))
        for a in mine:
            assert not any(a is not b and a["path"] == b["path"] and a["start_line"] <= b["end_line"] and b["start_line"] <= a["end_line"] for b in mine)


def test_forest(spark):
    assert catalog.QUERIES["budget_forest"](spark, SF).filter("predicted < 2000 OR predicted > 15000").isEmpty()
