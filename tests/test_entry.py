"""Driver contract: entry smoke check and every query against its DuckDB
oracle on the smallest driver tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["extractor", "total_packets", "time_s", "pps", "avg_cpu", "std_cpu",
                          "var_cpu", "max_ram", "std_ram", "var_ram"]


def test_every_query_has_an_oracle_or_is_rows_only():
    optional = {q for q in E.queries() if q == "pipeline" or re.match(r"op\d+_", q)}
    missing = set(E.queries()) - set(E.oracle_sql()) - optional
    assert missing == {"rf_scores", "rf_top_features", "flow_benchmark"}
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ocols, res.fetchall())
