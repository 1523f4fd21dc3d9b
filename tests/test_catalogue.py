"""Each registered query of the core engine against its SQL, on the driver's smallest tables where they are there."""

import decimal
import os
from pathlib import Path

import pytest

from lumenreel.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't there")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def in_order(columns, rows):
    """Rows with columns by name, sorted."""
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in place) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    found = catalogue.queries()[name](spark, FOLDER)
    want = tables.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert in_order(found.columns, found.collect()) == in_order(want.columns, want.fetchall())


@pytest.mark.parametrize(
    ("balances", "recovered"),
    [
        ({"HOUSEHOLD": [9999.8, 9999.79, 9999.79], "MACHINERY": [0.004, 0.003, 0.0], "FURNITURE": [7.5, 7.5, -1.0], "BUILDING": [5.0, 4.0]}, {0, 3, 7}),
        ({"HOUSEHOLD": [None, 3.0, 2.0], "MACHINERY": [None, None], "BUILDING": [None]}, {1}),
        ({"HOUSEHOLD": [float("nan"), 3.0], "MACHINERY": [1e300, 2e300, float("inf"), -float("inf")]}, {0, 4}),
    ],
    ids=["close", "none", "no cents"],
)
def test_orphan_recovery_by_whole_balances(spark, tmp_path, balances, recovered):
    """As its SQL does: 9999.8 is above 9999.79, though 100 times either is below 999980; parts of a cent count."""
    rows = [(i, balance, segment) for i, (segment, balance) in enumerate((s, b) for s, own in balances.items() for b in own)]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    found, want = catalogue.queries()["orphan_recovery"](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()["orphan_recovery"])
    got = found.collect()
    assert in_order(found.columns, got) == in_order(want.columns, want.fetchall())
    assert {r.video_id for r in got if r.file_path.startswith("/new/")} == recovered


def test_queries_without_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"file_hashes"}
