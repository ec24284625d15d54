"""Every query of the library against its SQL, on the smallest tables, and the three functions of the entry."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from docgraph.plans import registry
from docgraph.plans.model import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    want = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), cols)


@pytest.mark.parametrize("name", ["l_last_writer_wins", "v_duplicate_ids"])
def test_orders_are_taken_too(spark, name):
    assert any("order" in "".join(map(str, r)).lower() for r in registry.queries()[name](spark, DATA).collect())


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).parent.parent / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())
