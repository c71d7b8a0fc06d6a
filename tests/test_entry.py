import importlib
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{i}_found" for i in range(1, 6)} <= set(q)


def test_library_stands_without_the_text_package(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("lodestrata.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "lodestrata.llm", None)
    e = importlib.reload(entry)
    assert "p1_found" in e.queries() and "p6_found" not in e.queries()
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "kind_counts", "federate_heuristic", "narrowest_scope", "set_difference"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    pick = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in pick) for r in rel.fetchall())
