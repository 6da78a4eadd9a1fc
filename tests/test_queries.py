"""Queries over the smallest tables against their SQL."""

import duckdb
import pytest

from decidra.plans import audits, built, exchange

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "customer", "supplier", "orders", "lineitem", "events", "documents", "nation")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("module", [exchange, audits, built])
def test_queries_equal_their_sql(spark, duck, module):
    assert module.QUERIES.keys() == module.ORACLE.keys()
    for name, ask in module.QUERIES.items():
        df = ask(spark, DATA)
        columns = sorted(df.columns)
        got = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = sorted(repr([plain(v) for v in r]) for r in duck.sql(f"SELECT {quoted} FROM ({module.ORACLE[name]})").fetchall())
        assert got == want, name


def test_planted_defects_are_found(spark):
    found = {f.requirement for wrong in (False, True) for f in audits.report(spark, DATA, wrong).findings}
    assert found >= {"A2", "A3", "A5", "A10", "A10b", "A13", "A14", "C1", "C2", "C6", "N2", "N2i", "N6", "N8", "N12", "P5", "P8", "P9", "P10", "S6", "S7", "S8", "S9", "S10"}
