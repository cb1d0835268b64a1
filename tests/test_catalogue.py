"""Every registered query against its SQL, as rows regardless of order."""

import duckdb
import pytest

from quillon.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "lineitem", "orders", "part", "customer", "supplier", "nation"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


#: Queries without a counterpart: seeded programs and edits, and rounds that tests compare with written results.
UNSEEN = {"fuzz_campaign", "incremental_divergence", "split_resolution"}


def test_all_but_three_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == UNSEEN


def test_seeded_queries(spark):
    assert {r.diverged for r in catalogue.QUERIES["incremental_divergence"](spark, DATA).collect()} == {None}
    rows = catalogue.QUERIES["fuzz_campaign"](spark, DATA).collect()
    assert sum(r.seeds for r in rows) == 180 and True in {r.balanced for r in rows}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(str, r)) for r in got.select(*cols).collect()))
    assert rows == sorted(tuple(map(str, r)) for r in want.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall())
    assert rows or name in ("never_built", "thin_kinds")


def test_thin_kinds_beyond_twenty(spark, tmp_path):
    spark.createDataFrame([(i, f"http://h/{i}", f"<x{i}>t</x{i}>") for i in range(30)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.kind for r in catalogue.QUERIES["thin_kinds"](spark, str(tmp_path)).collect()}
    assert {f"x{i}" for i in range(30)} <= got


def test_registers_without_a_session():
    """Importing the queries asks for no Spark session."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    n, m = map(int, done.stdout.split())
    assert n >= m >= len(catalogue.ORACLE)
