import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators import hierarchy as H

S = "id string, parent string"


def brute(rows):
    parent = {i: p for i, p in rows}
    out = {}
    for i in parent:
        seen, at = [], i
        while True:
            if at in seen:
                out[i] = (None, -1 if at == i else -2, None)
                break
            seen.append(at)
            p = parent[at]
            if p not in parent:
                out[i] = (at, len(seen) - 1, seen[::-1])
                break
            at = p
    return out


def run(spark, rows):
    return {r["id"]: (r["root"], r["depth"], r["path"]) for r in H.resolve(spark.createDataFrame(rows, S), with_path=True).collect()}


def test_trees_cycles_and_tails(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    rows = [*chain, ("self", "self"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c1"), ("t2", "t1"), ("lost", "nobody"), ("kid", "lost")] + [(f"tail{i}", f"tail{i + 1}" if i < 20 else "c2") for i in range(21)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_null_ids(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "x"), ("a", None)]) == {"a": ("a", 0, ["a"])}


def test_descendants(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")]
    got = {(x["ancestor"], x["descendant"], x["distance"]) for x in H.descendants(spark.createDataFrame(rows, S)).collect()}
    assert got == {("r", "r", 0), ("r", "a", 1), ("r", "b", 2), ("a", "a", 0), ("a", "b", 1), ("b", "b", 0)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_random_forests(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    rows = [(f"n{i}", r.choice([None, "gone", *(f"n{r.randrange(n)}" for _ in range(6))])) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_hot_parent(spark, monkeypatch):
    from lodestrata.operators import skew

    monkeypatch.setattr(H, "hot_keys", lambda df, key, rows=None: skew.hot_keys(df, key, small_rows=5))
    rows = [("root", None), ("hub", "root"), *[(f"k{i}", "hub") for i in range(300)], *[(f"g{i}", f"k{i}") for i in range(50)]]
    assert run(spark, rows) == brute(rows)
