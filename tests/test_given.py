"""Queries over given inputs against their rows worked out by hand, and the new operators on nothing and on nulls."""

import pytest

import __spark_entry__ as entry
from lodestrata.operators import answers, drift, federation, ordering, refresh, resolve
from lodestrata.plans import fixtures
from lodestrata.sources import scip

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "given_rust_constants", "given_cargo_facts", "inherited_dependencies", "materialised_targets", "contract_formats", "compiler_overlay", "symbol_entities", "bound_documents",
    "alternatives_and_signatures", "alternative_rules", "given_git_objects", "impact_manifest", "client_declarations", "provider_changes", "client_classes", "affected_clients", "impact_guard",
    "blob_store", "published_documents", "staged_cache",
]


@pytest.mark.parametrize("name", NAMES)
def test_given_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    rel = duckdb.connect().sql(fixtures.SQL[name])
    df = fixtures.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    pick = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in pick) for r in rel.fetchall())


def test_every_query_has_one_name():
    mods = entry._modules()
    names = [n for m in mods for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_operators_on_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    chunks, docs = none("source_file_id string, hash string"), none("document_id string, path string, hash string, g string")
    assert refresh.chunk_rematerialisation(chunks, chunks, none("source_file_id string, reused boolean")).count() == 0
    assert refresh.document_rematerialisation(docs, docs).count() == 0 and refresh.changed_documents(docs, docs, "g").count() == 0
    ids = none("id string, value string")
    assert [tuple(r) for r in refresh.invalidation_report({"f": (ids, ids)}).collect()] == [("f", 0, 0, 0, 0)]
    assert resolve.sole_claim(none("id string"), none("id string, subject_id string")).count() == 0
    assert resolve.alternatives(none("file string, owner string, kind string, name string, id string, start long, end long")).count() == 0
    assert scip.symbol_entities(none("symbol string"), none("module_path string, owner string, name string, id string")).count() == 0
    assert ordering.dense_groups(none("g string, o long"), "g", "o").count() == 0
    assert answers.stale_documents(none("document_id string, repository string, snapshot_id string"), none("repository string, snapshot_id string")).count() == 0


def test_operators_on_nulls(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", None), ("c", 0), ("c", 0), (None, 0)], "g string, o long")
    assert {r["g"]: r["dense"] for r in ordering.dense_groups(rows, "g", "o").collect()} == {"a": True, "b": False, "c": False, None: True}
    docs = spark.createDataFrame([("1", "r", "s"), ("2", "r", None), ("3", None, "s")], "document_id string, repository string, snapshot_id string")
    heads = spark.createDataFrame([("r", "s")], "repository string, snapshot_id string")
    assert {r["document_id"]: r["state"] for r in answers.stale_documents(docs, heads).collect()} == {"1": "current", "2": "stale", "3": "unbound"}
    a = spark.createDataFrame([("k", ["x", None]), ("l", None)], "key string, v array<string>")
    got = {r["key"]: r["v"] for r in resolve.overlay_union(a, spark.createDataFrame([("k", ["y", "x"])], a.schema), "key", ["v"]).collect()}
    assert [x for x in got["k"] if x] == ["x", "y"] and got["l"] == []
    claims = spark.createDataFrame([("c1", "s"), ("c2", "t"), ("c3", "t"), ("c4", None)], "id string, subject_id string")
    assert {r["id"]: r["state"] for r in resolve.sole_claim(spark.createDataFrame([("s",), ("t",), ("u",), (None,)], "id string"), claims).collect()} == {"s": "claimed", "t": "ambiguous", "u": "missing", None: "missing"}
    none = spark.createDataFrame([], "client_id string, call_site_id string, fingerprint string")
    assert federation.declaration_conflicts(none).count() == 0


def test_hot_names_are_spread_without_changing_the_result(spark, monkeypatch):
    monkeypatch.setattr(resolve, "hot_keys", lambda df, key, **k: [r[0] for r in df.select(__import__("pyspark.sql.functions", fromlist=["x"]).xxhash64(key)).distinct().limit(3).collect()])
    left = spark.range(500).selectExpr("CAST(id % 4 AS string) AS k", "id AS n", "CAST(NULL AS string) AS z")
    right = spark.createDataFrame([("0", "a"), ("1", "b"), ("9", "c"), (None, "d")], "k string, v string")
    for how in ("left", "inner"):
        got, want = resolve.probe(left, right, ["k"], how), left.join(right, ["k"], how)
        assert sorted(map(str, got.select("k", "n", "v").collect())) == sorted(map(str, want.select("k", "n", "v").collect()))


def test_renames_are_followed_to_a_target_field(spark):
    changes = spark.createDataFrame([("s", 2, "renamed", "a", "a_v2"), ("s", 3, "renamed", "a_v2", "a_v3"), ("s", 4, "renamed", "b", "c"), ("s", 5, "added", "x", "")], "stream string, file_no int, change_kind string, field_path string, detail string")
    assert drift.approved_renames(changes, {"a": "string", "b": "integer", "c": "integer"}) == {"a": ("string", ["a_v2", "a_v3"])}
    assert drift.approved_renames(changes.limit(0), {"a": "string"}) == {}
