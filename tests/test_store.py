import pytest

from lodestrata.operators.store import Conflict, Store, canonical_lines, portable_graph, unreferenced
from lodestrata.streaming.refresh import distinct_revisions, refresh_each


def test_publish_head_and_sweep(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    s.publish("s1", {"entities": a})
    s.publish("s1", {"entities": a})
    with pytest.raises(Conflict):
        s.publish("s1", {"entities": a.limit(1)})
    assert s.load("s1", "entities").count() == 2
    assert s.head("repo") == (None, 0)
    assert s.compare_and_set("repo", None, "s1") == 1 and s.compare_and_set("repo", None, "s1") == 1
    s.publish("s2", {"entities": a.limit(1)})
    with pytest.raises(Conflict):
        s.compare_and_set("repo", "other", "s2")
    assert s.compare_and_set("repo", "s1", "s2") == 2 and s.head("repo") == ("s2", 2)
    s.publish("loose", {"entities": a})
    assert s.sweep(set()) == ["loose"] and s.load("s1", "entities").count() == 2


def test_canonical_export(spark):
    rows = spark.createDataFrame([("b", None), ("a", 1)], "id string, a_n int")
    assert [r["value"] for r in canonical_lines(rows, "id").collect()] == ['{"a_n":1,"id":"a"}', '{"a_n":null,"id":"b"}']
    m = {r["family"]: r["rows"] for r in portable_graph({"x": rows}).collect()}
    assert m == {"x": 2}
    refs = spark.createDataFrame([("a",), (None,)], "id string")
    assert [r["id"] for r in unreferenced(rows, refs, "id").collect()] == ["b"]


def test_stream_of_revisions(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.sql("SELECT 'r' AS repository, 'c1' AS commit, TIMESTAMP '2025-01-01 00:00:00' AS at UNION ALL SELECT 'r', 'c1', TIMESTAMP '2025-01-01 00:00:01' UNION ALL SELECT 'r', 'c2', TIMESTAMP '2025-01-01 00:01:00'").write.parquet(src)
    seen = []
    stream = spark.readStream.schema("repository string, commit string, at timestamp").parquet(src)
    q = refresh_each(distinct_revisions(stream, "at", ["repository", "commit"]), lambda df, i: seen.extend(r["commit"] for r in df.collect()), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted(seen) == ["c1", "c2"]
