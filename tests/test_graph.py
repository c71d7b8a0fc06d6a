import pytest
from pyspark.sql import functions as F

from lodestrata.operators import answers, federation, graph, integrity, inventory, ordering, resolve

EDGE = "id string, kind string, source string, target string"


def edges(spark, pairs, kind="CONTAINS"):
    return spark.createDataFrame([(f"{a}>{b}", kind, a, b) for a, b in pairs], EDGE)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_closure_with_cycle_and_long_chain(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    e = edges(spark, [*chain, ("x", "y"), ("y", "x"), ("x", "y")])
    got = set(rows(graph.transitive_closure(e), "source", "target"))
    assert got == {(f"n{i}", f"n{j}") for i in range(13) for j in range(i + 1, 13)} | {(a, b) for a in "xy" for b in "xy"}
    assert graph.transitive_closure(e.limit(0)).count() == 0


def test_neighbourhoods(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "a"), ("c", "d")])
    seeds = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.incident(e, seeds), "direction", "other") == [("in", "a"), ("out", "a"), ("out", "b")]
    got = rows(graph.bounded_traversal(e, seeds, 2, 256), "id", "hops", "truncated")
    assert got == [("a", 0, False), ("b", 1, False), ("c", 2, False)]
    star = edges(spark, [("hub", f"l{i:02d}") for i in range(9)])
    got = graph.bounded_traversal(star, spark.createDataFrame([("hub",)], "id string"), 2, 4)
    assert rows(got, "id", "truncated") == [("hub", True), ("l00", True), ("l01", True), ("l02", True)]


def test_path_slice(spark):
    e = edges(spark, [("s", "a"), ("a", "t"), ("s", "b"), ("b", "dead"), ("t", "after")])
    pairs = spark.createDataFrame([("s", "t")], "s string, t string")
    assert rows(graph.path_slice(e, graph.transitive_closure(e), pairs), "source", "target") == [("a", "t"), ("s", "a")]


def most_rows(spark, run):
    """The most rows that any operator gave in the plans that ``run`` executes."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = {x.executionId() for x in each(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    most = 0
    for x in each(store.executionsList()):
        if x.executionId() not in before:
            values = store.executionMetrics(x.executionId())
            for node in each(store.planGraph(x.executionId()).allNodes()):
                for m in each(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("down", [True, False])
def test_path_slice_of_a_wide_tree_stays_in_proportion(spark, down):
    n = 300
    way = lambda *x: x if down else x[::-1]
    e = edges(spark, [way("root", "mid"), *[way("mid", f"leaf{i}") for i in range(n)]])
    closure = graph.materialize(graph.transitive_closure(e))
    ends = spark.createDataFrame([way("root", f"leaf{i}") for i in range(n)], "s string, t string")
    got = []
    assert most_rows(spark, lambda: got.extend(tuple(r) for r in graph.path_slice(e, closure, ends).collect())) < 10 * n
    assert sorted(got) == sorted((*way("root", f"leaf{i}"), *x) for i in range(n) for x in (way("root", "mid"), way("mid", f"leaf{i}")))


@pytest.mark.parametrize("salted", [False, True])
def test_path_slice_against_every_path_end(spark, monkeypatch, salted):
    if salted:  # every key is hot
        monkeypatch.setattr(graph, "hot_keys", lambda df, key, *_: [r[0] for r in df.select(F.xxhash64(key)).distinct().collect()])
    bow = [*[(f"in{i}", "hub") for i in range(4)], *[("hub", f"out{i}") for i in range(5)]]
    links = [*bow, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "in0"), ("out0", "y"), ("a", "b")]
    e = edges(spark, [*links, ("a", None), (None, "b")])
    nodes = sorted({x for p in links for x in p})
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in links:
            for x in nodes:
                if a in reach[x]:
                    reach[x].add(b)
    wanted = sorted((s, t, a, b) for s in nodes for t in nodes for a, b in set(links) if a in reach[s] and t in reach[b])
    ends = spark.createDataFrame([*[(s, t) for s in nodes for t in nodes], ("a", "d"), ("a", None), (None, "d"), ("none", "d")], "s string, t string")
    assert rows(graph.path_slice(e, graph.transitive_closure(e), ends), "s", "t", "source", "target") == wanted
    assert graph.path_slice(e, graph.transitive_closure(e), ends.limit(0)).count() == 0
    assert graph.path_slice(e.limit(0), graph.transitive_closure(e.limit(0)), ends).count() == 0


def test_reaching_definitions_over_branches(spark):
    op = lambda b, o, i, v, k: ("f", b, o, i, v, k)
    ops = [op(0, 0, "p", "x", "write"), op(0, 1, "r0", "x", "read"), op(1, 0, "w1", "x", "write"), op(2, 0, "wy", "y", "write"), op(3, 0, "r3", "x", "read"), op(3, 1, "ry", "y", "read"), op(3, 2, "w3", "x", "write"), op(3, 3, "r4", "x", "read"), op(3, 4, "rz", "z", "read")]
    flow = [("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3)]
    got = graph.reaching_definitions(spark.createDataFrame(ops, "callable string, block long, ordinal long, op_id string, binding string, kind string"), spark.createDataFrame(flow, "callable string, source long, target long"))
    assert rows(got, "read_id", "definition_id", "mode") == [("r0", "p", "must"), ("r3", "p", "may"), ("r3", "w1", "may"), ("r4", "w3", "must"), ("ry", "wy", "may")]


def test_evidence_closure(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "y"), ("c", None)], "id string, evidence_id string")
    assert rows(graph.evidence_closure(spark.createDataFrame([("a",), (None,)], "id string"), refs), "id") == [("a",), ("b",), ("c",)]


def test_evidence_closure_of_a_long_chain(spark):
    refs = spark.range(5_000).selectExpr("concat('n', id) AS id", "concat('n', id + 1) AS evidence_id").unionByName(spark.createDataFrame([("n4000", "n3"), ("n7", "side"), ("lost", "n9")], "id string, evidence_id string"))
    got = graph.evidence_closure(spark.createDataFrame([("n0",)], "id string"), refs)
    assert {r["id"] for r in got.collect()} == {f"n{i}" for i in range(5_001)} | {"side"}


def test_fixpoints_that_run_out_of_rounds_raise(spark, monkeypatch):
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(40)])
    monkeypatch.setattr(graph, "MAX_ROUNDS", 2)
    with pytest.raises(graph.Unfinished):
        graph.transitive_closure(chain)
    with pytest.raises(graph.Unfinished):
        graph.evidence_closure(spark.createDataFrame([("n0",)], "id string"), chain.select(F.col("source").alias("id"), F.col("target").alias("evidence_id")))
    monkeypatch.setattr(graph, "MAX_LEVELS", 2)
    ops = spark.createDataFrame([("f", 0, 0, "w", "x", "write"), ("f", 3, 0, "r", "x", "read")], OPS)
    flow = "callable string, source long, target long"
    with pytest.raises(graph.Unfinished):
        graph.reaching_definitions(ops, spark.createDataFrame([("f", i, i + 1) for i in range(3)], flow))
    monkeypatch.undo()
    with pytest.raises(graph.Unfinished):
        graph.reaching_definitions(ops, spark.createDataFrame([("f", 0, 3), ("f", 3, 4), ("f", 4, 3)], flow))
    assert graph.reaching_definitions(ops.limit(0), spark.createDataFrame([], flow)).count() == 0


OPS = "callable string, block long, ordinal long, op_id string, binding string, kind string"
SPAN = "id string, path string, start long, end long"


def test_spans(spark):
    outer = spark.createDataFrame([("big", "f", 0, 20_000), ("mid", "f", 100, 9_000), ("twin", "f", 100, 9_000), ("small", "f", 200, 300), ("other", "g", 0, 999), ("bad", "f", 9, 1)], SPAN)
    inner = spark.createDataFrame([("i1", "f", 250, 260), ("i2", "f", 5_000, 5_001), ("i3", "f", 15_000, 15_001), ("i4", "h", 1, 2)], SPAN)
    pairs = resolve.containing(inner, outer, ["path"])
    assert rows(pairs, "inner_id", "outer_id") == [("i1", "big"), ("i1", "mid"), ("i1", "small"), ("i1", "twin"), ("i2", "big"), ("i2", "mid"), ("i2", "twin"), ("i3", "big")]
    assert rows(resolve.narrowest(pairs), "inner_id", "outer_id", "shadowed") == [("i1", "small", False), ("i2", None, True), ("i3", "big", False)]
    assert rows(resolve.sole_owner(pairs), "inner_id", "owner_id", "owners") == [("i1", None, 4), ("i2", None, 3), ("i3", "big", 1)]


def test_names(spark):
    names = spark.createDataFrame([("1", "c", "m", "f"), ("2", "c", "n", "f"), ("3", "c", "n", "g")], "id string, crate string, module string, name string")
    calls = spark.createDataFrame([("a", "c", "m", "f", False), ("b", "c", "m", "g", False), ("d", "c", "m", "g", True), ("e", "c", "x", "f", False), ("k", None, None, "f", False)], "call_id string, crate string, module string, name string, qualified boolean")
    assert rows(resolve.two_tier(calls, names), "call_id", "target", "tier") == [("a", "1", "exact"), ("b", "3", "crate"), ("d", None, "unresolved"), ("e", None, "unresolved"), ("k", None, "unresolved")]
    kinds = spark.createDataFrame([("p", "struct", "1"), ("q", "struct", "2"), ("q", "fn", "3")], "path string, kind string, id string")
    imports = spark.createDataFrame([("i", "p"), ("j", "q"), ("k", "z")], "import_id string, path string")
    assert rows(resolve.sole_kind(imports, kinds), "import_id", "target", "kinds") == [("i", "1", 1), ("j", None, 2), ("k", None, 0)]
    files = spark.createDataFrame([("src/a.rs",), ("src/b/mod.rs",), ("src/c.rs",), ("src/c/mod.rs",)], "path string")
    mods = spark.createDataFrame([("src/a",), ("src/b",), ("src/c",), ("src/d",)], "module string")
    assert rows(resolve.module_file(mods, files), "module", "state") == [("src/a", "resolved"), ("src/b", "resolved"), ("src/c", "ambiguous"), ("src/d", "missing")]


def test_inventory_rules(spark):
    files = [("build.rs", "100644", b"fn main(){}"), ("tools/x.sh", "100755", b"#!"), ("Cargo.toml", "100644", b"[package]"), ("api/openapi.yaml", "100644", b"openapi: 3.1.0"), ("b/openapi.yaml", "100644", b"x"), (".github/CODEOWNERS", "100644", b"*"), ("README.md", "100644", b"\xff"), ("x.bin", "100644", b"ok"), (None, None, None)]
    got = {r["path"]: r for r in inventory.classify(spark.createDataFrame(files, "path string, mode string, bytes binary")).collect()}
    assert got["build.rs"]["roles"] == ["sentinel", "source"] and got["build.rs"]["sentinel"]
    assert got["tools/x.sh"]["roles"] == ["sentinel", "source"] and got["tools/x.sh"]["languages"] == ["shell"]
    assert got["api/openapi.yaml"]["recognized_kind"] == "openapi_contract" and got["b/openapi.yaml"]["unsupported"]
    assert got["README.md"]["content_kind"] == "binary_or_unknown" and got["x.bin"]["roles"] == ["unsupported"] and got[None]["unsupported"]


def test_boundaries(spark):
    g = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, oid string")
    dcl = spark.createDataFrame([("a",), ("b",), ("z",)], "path string")
    n = spark.createDataFrame([("a", "1"), ("c", "3"), ("d", "9")], "path string, oid string")
    got = {r["path"]: (r["state"], r["gaps"]) for r in inventory.boundary_report(g, dcl, n).collect()}
    assert got["a"] == ("explicitly_bound", ["boundary.nested_repository_not_analyzed"]) and got["b"][0] == "declared_unbound"
    assert got["c"] == ("explicitly_bound", ["boundary.gitmodules_declaration_missing", "boundary.nested_repository_not_analyzed"])
    assert got["d"][0] == "invalid" and got["z"] == ("orphan_declaration", ["boundary.gitmodules_declaration_orphan"])


def test_refresh_rules(spark):
    plans = spark.createDataFrame([(i, i == 2, i != 1) for i in range(1, 8)], "plan_id int, same_commit boolean, compatible boolean")
    changes = [(3, "Cargo.toml", "modified", True), (4, "src/a.rs", "modified", True), (5, "src/b.rs", "modified", True), (6, "src/c.rs", "added", True), (7, "src/c.rs", "modified", False)]
    stable = spark.createDataFrame([(4, "src/a.rs")], "plan_id int, path string")
    got = dict(rows(federation.refresh_rule(plans, spark.createDataFrame(changes, "plan_id int, path string, change_kind string, content_changed boolean"), stable), "plan_id", "outcome"))
    assert got == {1: "full_rebuild", 2: "no_change", 3: "full_workspace_analysis", 4: "partial_analysis", 5: "full_workspace_analysis", 6: "full_workspace_analysis", 7: "inventory_only"}


def test_impact(spark):
    contract = spark.createDataFrame([("/a", False), ("/b", True), ("/c", False), ("/d", False)], "json_pointer string, required boolean")
    old = spark.createDataFrame([("/a", "guaranteed_present"), ("/b", "guaranteed_present"), ("/c", "guaranteed_present")], "json_pointer string, presence string")
    new = spark.createDataFrame([("/a", "may_be_absent"), ("/b", "may_be_absent"), ("/c", "guaranteed_present")], "json_pointer string, presence string")
    change = federation.presence_change(contract, old, new)
    assert rows(change, "json_pointer", "classification") == [("/a", "breaking"), ("/b", "unsupported"), ("/c", "none"), ("/d", "unresolved")]
    clients = spark.createDataFrame([("strict", "/a", "requires_present"), ("safe", "/a", "handles_absent"), ("far", "/c", "requires_present")], "client_id string, json_pointer string, assumption string")
    assert rows(federation.client_assessment(change, clients), "client_id", "effect", "affected") == [("safe", "compatible", False), ("strict", "breaking", True)]


def test_global_order_and_percentiles(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    got = ordering.global_ordinal(df, ["x"])
    assert got.where("ordinal <> x + 1").count() == 0 and got.count() == 1000
    p = dict(rows(ordering.nearest_rank(df.where("g = 0"), "g", "x", [50]), "percent", "x"))
    vals = sorted(r["x"] for r in df.where("g = 0").collect())
    assert p[50] == vals[(len(vals) + 1) // 2 - 1]


def test_violations_and_hashes(spark):
    ent = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    rel = spark.createDataFrame([("r", "a", "zz")], "id string, source string, target string")
    cl = spark.createDataFrame([("c", "r"), ("d", "nobody")], "id string, subject_id string")
    ev = spark.createDataFrame([("e", "p", 5, 1), ("f", None, 0, 1)], "id string, path string, start_byte long, end_byte long")
    assert rows(integrity.violations(ent, rel, cl, ev), "rule", "subject_id") == [("claim.subject_missing", "d"), ("entity.duplicate_id", "a"), ("evidence.bad_span", "e"), ("evidence.no_path", "f"), ("relationship.target_missing", "r")]
    t = spark.createDataFrame([("g", "k1", "v"), ("g", "k2", None), ("h", "k2", None), ("h", "k1", "v"), ("i", "k1", "w")], "g string, k string, v string")
    h = {r["g"]: r["digest"] for r in integrity.generation_hash(t, ["g"], "k", ["v"]).collect()}
    assert h["g"] == h["h"] != h["i"]


def test_lookup_and_context(spark):
    fam = {"entity": spark.createDataFrame([("x",), ("y",)], "id string"), "evidence": spark.createDataFrame([("y",), ("e",)], "id string")}
    ids = spark.createDataFrame([("x",), ("y",), ("e",), ("q",)], "id string")
    assert rows(answers.lookup(ids, fam), "id", "family") == [("e", "evidence"), ("q", None), ("x", "entity"), ("y", "entity")]
    assert answers.lookup_one("e", fam)[0] == "evidence"
    try:
        answers.lookup_one("q", fam)
        raise AssertionError
    except answers.UnknownId:
        pass
    ctx = answers.function_context(
        spark.createDataFrame([("f", "run", "o", "e1"), ("g", "help", "o", "lost")], "id string, name string, owner_id string, evidence_id string"),
        spark.createDataFrame([("f", 1, "b"), ("f", 0, "a")], "callable string, ordinal int, name string"),
        spark.createDataFrame([("f", 0, "l", "let", "e1")], "callable string, ordinal int, id string, kind string, evidence_id string"),
        spark.createDataFrame([("c", "f", "g", None)], "id string, source string, target string, evidence_id string"),
        spark.createDataFrame([("k", "l", "candidate")], "id string, subject_id string, state string"),
        spark.createDataFrame([("c", "calls")], "subject_id string, capability string"),
        spark.createDataFrame([("e1", "p", 0, 9)], "id string, path string, start_byte long, end_byte long"),
    )
    got = {r["callable"]: r for r in ctx.collect()}
    assert [p["name"] for p in got["f"]["parameters"]] == ["a", "b"] and got["f"]["outgoing"] == ["g"] and got["f"]["complete"] and got["f"]["coverage_gaps"] == ["calls"]
    assert got["g"]["incoming"] == ["f"] and not got["g"]["complete"]


def test_excerpts(spark):
    text = "één\nzwei drei\n"
    files = spark.createDataFrame([("p", "b", bytearray(text.encode()))], "path string, blob_oid string, bytes binary")
    ev = spark.createDataFrame([("ok", "p", "b", 6, 10), ("mid", "p", "b", 1, 4), ("far", "p", "b", 0, 999), ("none", "q", "b", 0, 1), ("long", "p", "b", 0, 16)], "id string, path string, blob_oid string, start_byte long, end_byte long")
    got = {r["evidence_id"]: r for r in answers.source_excerpts(ev, files, limit=15).collect()}
    ok = got["ok"]
    assert (ok["excerpt"], ok["start_line"], ok["start_column"], ok["end_line"], ok["end_column"]) == ("zwei", 2, 1, 2, 5)
    assert {k: got[k]["problem"] for k in ("mid", "far", "none", "long")} == {"mid": "inside_character", "far": "out_of_range", "none": "no_file", "long": "too_long"}


def test_documents_limits_and_denied_fields(spark):
    import pytest
    from pyspark.sql import types as T

    m = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), (None, "x", 1)], "k string, sha256 string, byte_length long").withColumn("sha256", F.sha2(F.lit("t"), 256))
    b = spark.createDataFrame([("a", "t"), ("c", "t"), (None, "u")], "k string, body string")
    assert rows(answers.validate_documents(m, b, ["k"]), "k", "state") == [("a", "sound"), ("b", "no_body"), ("c", "no_manifest"), (None, "digest_differs")]
    doc = "path string, blob_oid string, byte_length long, sha256 string"
    inv = spark.createDataFrame([("p", "1", 1, "x"), ("q", "2", 2, None), ("r", "1", 1, "x"), ("r", "1", 1, "x")], doc)
    bound = spark.createDataFrame([("p", "1", 1, "x"), ("q", "2", 3, None), ("z", "1", 1, "x"), ("r", "1", 1, "x")], doc)
    assert rows(answers.bind_documents(bound, inv), "path", "state") == [("p", "bound"), ("q", "differs"), ("r", "ambiguous"), ("z", "missing")]
    assert integrity.within_limit(inv, 4, "x").count() == 4
    with pytest.raises(integrity.LimitExceeded):
        integrity.within_limit(inv, 3, "x")
    schema = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("Token", T.StringType())]))), T.StructField("m", T.MapType(T.StringType(), T.StructType([T.StructField("secret", T.StringType())])))])
    assert integrity.denied_fields(schema, {"token", "secret"}) == ["a.Token", "m.secret"]
