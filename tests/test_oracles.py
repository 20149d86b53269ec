"""The registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
import math
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from flowtide.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def answers(spark):
    """name -> future of (columns, rows) by Spark; several queries run at a time."""

    def ask(name):
        df = registry.QUERIES[name](spark, SF)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(ask, name) for name in sorted(registry.ORACLES)}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(answers, tables, name):
    columns, got = answers[name].result()
    want = tables.sql(registry.ORACLES[name])
    assert sorted(columns) == sorted(want.columns)
    assert rows(columns, got) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_imports_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr
