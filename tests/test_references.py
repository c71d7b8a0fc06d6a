from datetime import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import references as R
from lodestrata.operators.skew import hot_keys, skew_join

T = "id string, recorded_at timestamp, ingested_at timestamp, deleted_at timestamp"


def targets(spark):
    rows = [("a", dt(2025, 1, 1), None, None), ("a", dt(2025, 3, 1), None, dt(2025, 4, 1)), ("b", dt(2025, 5, 1), None, None), ("c", dt(2025, 1, 1), None, dt(2025, 1, 2)), ("c", dt(2025, 2, 1), None, None), (None, dt(2025, 1, 1), None, None)]
    return R.target_states(spark.createDataFrame(rows, T), ["id"])


def micros(d):
    return int((d - dt(1970, 1, 1)).total_seconds() * 1_000_000)


def test_status_of_references(spark):
    refs = spark.createDataFrame([("1", "a", micros(dt(2025, 2, 1))), ("2", "b", micros(dt(2025, 4, 1))), ("3", "b", micros(dt(2025, 5, 1))), ("4", "x", 0), ("5", "c", micros(dt(2025, 9, 1))), ("6", None, 0)], "rec string, id string, at long")
    got = {r["rec"]: r["status"] for r in R.find_orphans(refs, targets(spark), ["id"], "at").collect()}
    assert got == {"1": "deleted", "2": "late", "4": "missing"}


def test_null_masks_under_each_semantics(spark):
    t = spark.createDataFrame([("t", "1", 0, False), ("u", "2", 0, False)], "k1 string, k2 string, first_seen long, target_deleted boolean")
    refs = spark.createDataFrame([("full", "t", "1"), ("bad", "t", "2"), ("part", "t", None), ("partbad", "z", None), ("none", None, None)], "rec string, k1 string, k2 string").withColumn("at", F.lit(1).cast("long"))
    run = lambda m: {(r["rec"], r["status"]) for r in R.find_orphans(refs, t, ["k1", "k2"], "at", m).collect()}
    assert run("simple") == {("bad", "missing")}
    assert run("partial") == {("bad", "missing"), ("partbad", "missing")}
    assert run("full") == {("bad", "missing"), ("part", "malformed"), ("partbad", "malformed")}


def test_empty_tables(spark):
    none = targets(spark).limit(0)
    refs = spark.createDataFrame([("1", "a", 0)], "rec string, id string, at long")
    assert [r["status"] for r in R.find_orphans(refs, none, ["id"], "at").collect()] == ["missing"]
    assert R.find_orphans(refs.limit(0), targets(spark), ["id"], "at").count() == 0


def test_counting_row_and_repeats(spark):
    rows = spark.createDataFrame([(" A ", dt(2025, 1, 1), None, "old"), ("a", dt(2025, 2, 1), None, "new"), ("a", dt(2025, 2, 1), None, "new"), ("", None, None, "x"), (None, None, None, "y")], "id string, recorded_at timestamp, ingested_at timestamp, v string")
    assert [(r["record_id"], r["v"]) for r in R.counting_rows(rows, ["v"]).collect()] == [("a", "new")]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("n"))
    right = spark.createDataFrame([("hot", 1), ("7", 2), (None, 3)], "k string, v int")
    hot = hot_keys(left, F.col("k"), small_rows=10)
    assert len(hot) == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew_join(left, right, "k", how, hot, F.col("n"))
        b = left.join(right, "k", how)
        cols = sorted(b.columns)
        assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and a.count() == b.count()
    assert hot_keys(left.limit(0), F.col("k")) == []
