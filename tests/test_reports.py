import json

from lodestrata.operators import reports as R
from lodestrata.sources.rust import decode_literal


def client(**binding):
    return json.dumps({"role": "x", "repository_identity": "r", "revision": "a" * 40, "source_path": "src/a.kt", "symbol_identity": "f", "binding": binding, "extra": 1})


def test_client_documents(spark):
    texts = [client(kind="explicit", method="GET", path_template="/u/{id}"), client(kind="explicit", method="GET", path_template="u"), client(kind="heuristic", service_hint="s"), client(kind="other"), "{", None, client(kind="explicit").replace("a" * 40, "main")]
    rows = R.read_documents(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", R.CLIENT)
    assert [r["broken"] for r in rows.orderBy("i").collect()] == [False, False, False, False, True, True, False]
    assert sorted(str(r["problem"]) for r in R.client_bindings(rows).collect()) == sorted(["None", "explicit_binding", "heuristic_binding", "binding_kind", "malformed", "malformed", "revision"])


def test_report_and_its_references(spark):
    fam = {"clients": spark.createDataFrame([("c1", 1)], "id string, n int"), "links": spark.createDataFrame([("l1", "c1"), ("l2", "gone"), ("l3", None)], "id string, client string")}
    assert {(r["family"], r["rows"]) for r in R.summary(fam).collect()} == {("clients", 1), ("links", 3)}
    assert [(r["family"], r["id"]) for r in R.unresolved(fam, [("links", "client", "clients", "id")]).collect()] == [("links", "gone")]
    body = {r["id"]: r["body"] for r in R.report(fam, {"clients": "id", "links": "id"}).collect()}
    assert body["l3"] == '{"client":null,"id":"l3"}'


def test_literals():
    assert [decode_literal(x) for x in (r'"a\n\u{e9}\x41"', "r#\"a\"b\"#", r"'\''", r'b"x"', '"\\q"', "5", '"a\\\n   b"')] == ["a\né" + "A", 'a"b', "'", "x", None, None, "ab"]
