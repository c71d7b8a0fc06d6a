import json
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import drift as D

TARGET = {"a": "integer", "b": "string", "n.x": "array", "f": "number", "t": "boolean"}
RAW = "stream string, file_no int, subject_key string, body string"


def changes(spark, rows, target=TARGET):
    raw = spark.createDataFrame(rows, RAW)
    got = D.field_changes(D.field_values(D.ingest(raw, target), target, ["stream", "file_no", "subject_key"]), raw)
    return {(r["stream"], r["file_no"], r["change_kind"], r["field_path"], r["detail"]) for r in got.collect()}


def kind(v):
    return "boolean" if isinstance(v, bool) else {int: "integer", float: "number", str: "string", list: "array"}[type(v)]


def brute(rows):
    fields, files = defaultdict(lambda: defaultdict(list)), defaultdict(set)
    for s, n, k, body in rows:
        files[s].add(n)
        try:
            doc = json.loads(body)
        except (ValueError, TypeError):
            continue
        stack = [("", doc)] if isinstance(doc, dict) else []
        while stack:
            p, o = stack.pop()
            for m, v in o.items():
                if isinstance(v, dict):
                    stack.append((f"{p}{m}.", v))
                elif v is not None:
                    fields[s, n][p + m].append((k, v))
    out = set()
    for s, ns in files.items():
        ns = sorted(ns)
        for a, b in zip(ns, ns[1:]):
            old, new = fields[s, a], fields[s, b]
            pairs = set()
            for o in set(old) - set(new):
                for w in set(new) - set(old):
                    both = [(json.dumps(x, sort_keys=True), json.dumps(y, sort_keys=True)) for k, x in old[o] for j, y in new[w] if k == j and k is not None]
                    if both and all(x == y for x, y in both):
                        pairs.add((o, w))
            out |= {(s, b, "renamed", o, w) for o, w in pairs}
            out |= {(s, b, "removed", o, "") for o in set(old) - set(new) - {o for o, _ in pairs}}
            out |= {(s, b, "added", w, "") for w in set(new) - set(old) - {w for _, w in pairs}}
            for p in set(old) & set(new):
                x, y = ("|".join(sorted({kind(v) for _, v in side[p]})) for side in (old, new))
                if x != y:
                    out.add((s, b, "type_changed", p, f"{x}->{y}"))
    return out


def test_changes_between_files(spark):
    rows = [
        ("s", 1, "k1", '{"a": 1, "b": "x", "n": {"x": [1, {"z": 1, "y": 2}]}, "old": 5}'),
        ("s", 1, "k2", '{"a": 2, "b": null}'),
        ("s", 3, "k1", '{"a": 1.5, "b": "x", "m": {"x": [1, {"y": 2, "z": 1}]}, "new": 5, "f": 2}'),
        ("s", 3, "k9", "{broken"), ("s", 3, None, None), ("s", 3, "k8", "[1]"), ("s", 4, "k3", "nope"),
    ]
    got = changes(spark, rows)
    assert got == brute(rows)
    assert ("s", 3, "renamed", "old", "new") in got and ("s", 3, "renamed", "n.x", "m.x") in got and ("s", 3, "type_changed", "a", "integer->number") in got


def test_empty(spark):
    raw = spark.createDataFrame([], RAW)
    assert D.field_changes(D.field_values(D.ingest(raw, TARGET), TARGET, ["stream", "file_no", "subject_key"]), raw).count() == 0


value = st.one_of(st.integers(-3, 3), st.booleans(), st.sampled_from(["x", "é", ""]), st.lists(st.integers(0, 2), max_size=2), st.none(), st.sampled_from([0.5, 1.0]))
doc = st.dictionaries(st.sampled_from(["a", "b", "f", "t", "u", "A"]), st.one_of(value, st.dictionaries(st.sampled_from(["x", "y"]), value, max_size=2)), max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["s", "r"]), st.integers(1, 3), st.sampled_from(["k1", "k2", None]), doc), max_size=10))
def test_against_brute_force(spark, rows):
    rows = [(s, n, k, json.dumps(d)) for s, n, k, d in rows]
    assert changes(spark, rows) == brute(rows)


def test_rescue_and_replay(spark):
    raw = spark.createDataFrame([("s", 1, "k", '{"a": "12", "b": 5, "extra": {"q": "v"}, "n": {"x": [2]}}'), ("s", 1, "j", '{"a": 3, "a2": "7"}'), ("s", 1, "i", None)], RAW)
    t = D.ingest(raw, TARGET)
    r = {x["subject_key"]: x for x in t.withColumn("json", D.rescued_json()).collect()}
    assert r["k"]["a"] is None and json.loads(r["k"]["json"]) == {"a": "12", "b": 5, "extra.q": "v"} and r["k"]["n__x"] == "[2]"
    assert r["i"]["body_state"] == "broken" and r["j"]["a"] == 3
    p = {x["subject_key"]: x for x in D.promote(t, {"a": ("integer", ["a", "a2"]), "extra.q": ("string", ["extra.q"])}).withColumn("json", D.rescued_json()).collect()}
    assert p["k"]["a"] == 12 and p["k"]["extra__q"] == "v" and json.loads(p["k"]["json"]) == {"b": 5}
    assert p["j"]["a"] == 3 and json.loads(p["j"]["json"]) == {"a2": "7"}


def test_clashing_columns_are_renamed(spark):
    raw = spark.createDataFrame([("s", 1, "k", '{"a": 5}')], RAW).withColumn("a", F.lit("mine")).withColumn("rescued", F.lit(1))
    r = D.ingest(raw, TARGET).first()
    assert (r["a"], r["record_a"], r["record_rescued"], r["rescued"]) == (5, "mine", 1, {})


def test_many_changes_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_LIMIT_BYTES", 0)
    monkeypatch.setattr(D, "hot_keys", lambda df, key: [r["h"] for r in df.select(F.xxhash64(key).alias("h")).distinct().collect()])
    rows = [("s", n, f"k{i}", json.dumps({"old" if n == 1 else "new": i, "a": n})) for n in (1, 2) for i in range(20)]
    assert changes(spark, rows) == brute(rows) == {("s", 2, "renamed", "old", "new")}
