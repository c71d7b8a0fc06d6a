from datetime import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import snapshots as S

SCHEMA = "g string, v long, at timestamp, k string, val string, change_kind string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((r["g"], r["v"], r["k"], r["change_kind"]) for r in S.snapshot_changes(df, "g", "v", "at", "k", F.col("val")).collect())


def brute(rows):
    latest, snaps = {}, {}
    for g, v, at, k, val in rows:
        if None not in (g, v, at, k):
            latest[g, v] = max(at, latest.get((g, v), at))
    for g, v, at, k, val in rows:
        if None not in (g, v, at, k) and latest[g, v] == at:
            snaps.setdefault((g, v), {})[k] = val
    out = []
    for g in {g for g, _ in snaps}:
        vs = sorted(v for h, v in snaps if h == g)
        for a, b in zip(vs, vs[1:]):
            x, y = snaps[g, a], snaps[g, b]
            out += [(g, b, k, "added") for k in y.keys() - x.keys()] + [(g, b, k, "deleted") for k in x.keys() - y.keys()] + [(g, b, k, "modified") for k in x.keys() & y.keys() if x[k] != y[k]]
    return sorted(out)


def d(n):
    return dt(2025, 1, n)


def test_deliveries_gaps_and_nulls(spark):
    rows = [("g", 1, d(1), "a", "1"), ("g", 1, d(1), "b", None), ("g", 1, d(1), "a", "1"), ("g", 4, d(2), "a", "9"), ("g", 4, d(3), "b", "2"), ("g", 4, d(3), "c", None), ("g", 9, d(1), "b", None), ("g", 9, d(1), "c", None), ("h", 1, d(1), "a", "1"), (None, 1, d(1), "a", "1"), ("g", None, d(1), "z", "1"), ("g", 9, None, "z", "1"), ("g", 9, d(1), None, "1")]
    assert run(spark, rows) == brute(rows)


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", 0)
    monkeypatch.setattr(S, "hot_keys", lambda df, key: [r["h"] for r in df.select(F.xxhash64(key).alias("h")).distinct().collect()])
    monkeypatch.setattr(S, "broadcast_if_small", lambda df, of=None: df)
    rows = [("g", v, d(1), f"k{i}", str(i // (v + 1))) for v in (1, 2, 5) for i in range(v, 30)] * 2
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("gh"), st.integers(1, 4), st.just(d(1)), st.sampled_from("abcdef"), st.sampled_from(["1", "2", None])), max_size=30, unique_by=lambda r: (r[0], r[1], r[3])))
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hash_arrays_alone():
    k = np.array([1, 1, 2, 3, 2], dtype=np.int64)
    rank = np.array([1, 2, 1, 2, 2], dtype=np.int64)
    first, last = rank == 1, rank == 2
    idx, gen, kind = S.diff_arrays(k, k, rank, first, last, np.array([5, 6, 7, 8, 7], dtype=np.int64))
    assert sorted(zip(k[idx], gen, kind)) == [(1, 2, 2), (3, 2, 0)]
    assert len(S.diff_arrays(*(np.empty(0, dtype=np.int64),) * 6)[0]) == 0


def test_plain_path(spark):
    got = spark.createDataFrame([(" ./a//b\\c.rs ",), ("././x",), (None,)], "p string").select(S.plain_path(F.col("p")).alias("p")).collect()
    assert [r["p"] for r in got] == ["a/b/c.rs", "x", None]
