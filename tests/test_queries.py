"""Every registered query against its oracle SQL in DuckDB."""

import os

import duckdb
import pytest

from geoloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is not None and type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in con.fetchall()), key=repr)


def test_size_mismatch_takes_every_part(spark, sf, con, monkeypatch):
    seen = []
    monkeypatch.setattr(registry.tiles, "size_mismatches", lambda e, i: seen.append(i.count()) or e)
    registry.size_mismatch(spark, sf)
    assert seen == [con.execute("select count(distinct l_partkey) from lineitem").fetchone()[0]]


def test_join_anti_takes_every_order(spark, sf):
    plan = registry.join_anti(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in plan and "Filter" not in plan


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
