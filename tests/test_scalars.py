from pyspark.sql import functions as F

from lodestrata.functions import scalars as S


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first()["x"]


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_text_forms(spark):
    assert each(spark, S.module_slug, ["workspace_A::b_c", "a  b", "::", "", None, "-x-"]) == ["a-b-c", None, None, None, None, "x"]
    assert each(spark, S.markdown_code, ["<a>&`[x]`", None]) == ["&lt;a&gt;&amp;&#96;&#91;x&#93;&#96;", None]
    assert each(spark, S.url_kind, ["./x", "/x", "file:///x", "ssh://h", "https://h", "http://h", "git://h", "git@h:x", "h:x", "weird", None]) == ["relative", "absolute_path", "file", "ssh", "https", "http", "git", "scp_like", "other", "other", None]
    assert each(spark, S.normal_path, ["a/./b/../c", "../x", "/abs", "a\\b", "", None]) == ["a/c", None, None, None, "", None]
    assert each(spark, S.http_path, ['"/users/$id"', '"/a//b"', '"/a/"', '"/"', "/bare", '"/{x}"']) == ["/users/{id}", None, None, "/", None, None]
    assert each(spark, S.visibility, ["pub fn x", "pub(crate) fn x", "fn x"]) == ["public", "restricted:crate", "private"]
    assert each(spark, S.is_safe_path, ["a/b", "a//b", "../x", "a\\b", ""]) == [True, False, False, False, False]
    assert each(spark, S.pointer_escape, ["a/b~c"]) == ["a~1b~0c"]
    assert each(spark, S.nfc, ["é", "abc", None]) == ["é", "abc", None]


def test_structs(spark):
    lit = each(spark, S.integer_literal, ["0xFF_u8", "-1_000i64", "0b12", "abc"])
    assert (lit[0]["radix"], lit[0]["digits"], lit[0]["suffix"]) == (16, "ff", "u8") and (lit[1]["sign"], lit[1]["digits"]) == ("-", "1000") and lit[2] is None and lit[3] is None
    imp = each(spark, S.import_paths, ["use a::{b, c as d, self};", "x::y as z"])
    assert [(p["path"], p["alias"]) for p in imp[0]] == [("a::b", None), ("a::c", "d"), ("a", None)] and [(p["path"], p["alias"]) for p in imp[1]] == [("x::y", "z")]
    f = each(spark, S.feature_member, ["dep:serde", "serde?/std", "x/y", "plain"])
    assert [x["kind"] for x in f] == ["dependency", "dependency_feature", "dependency_feature", "feature"] and f[1]["weak"] and f[1]["dependency"] == "serde"
    s = each(spark, S.scip_symbol, ["rust cargo pkg 1.0 a/b#", "local 3"])
    assert s[0]["package"] == "pkg" and s[0]["descriptors"] == "a/b#" and s[1]["local"]


def test_ids_and_offsets(spark):
    import hashlib

    assert one(spark, S.stable_id("x", F.col("a"), F.col("b")), a="p", b="q") == "urn:lodestrata:x:sha256:" + hashlib.sha256(b'["p","q"]').hexdigest()
    data = "ab\né!".encode()
    df = spark.createDataFrame([(bytearray(data), o) for o in range(-1, 8)], "d binary, o long")
    got = [r["p"] and (r["p"]["line"], r["p"]["column"]) for r in df.select(S.line_column(F.col("d"), F.col("o")).alias("p")).collect()]
    assert got == [None, (1, 1), (1, 2), (1, 3), (2, 1), None, (2, 2), (2, 3), None]
    t = spark.createDataFrame([("ab\né!x", 1, 1)], "t string, l int, c int")
    assert t.select(S.byte_offset(F.col("t"), F.col("l"), F.col("c")).alias("x")).first()["x"] == 5
    assert t.select(S.excerpt_lines(F.col("t"), F.lit(2), F.lit(2)).alias("x")).first()["x"] == "é!x"
    assert one(spark, S.rfc3339(F.lit(0))) == "1970-01-01T00:00:00Z"


def test_checked_arithmetic(spark):
    calc = lambda op, a, b, t: one(spark, S.checked(op, F.lit(a).cast("decimal(38,0)"), F.lit(b).cast("decimal(38,0)"), F.lit(t)))
    assert calc("+", 100, 27, "i8") == 127 and calc("+", 100, 28, "i8") is None and calc("-", 0, 1, "u8") is None
    assert calc("/", -7, 2, "i32") == -3 and calc("%", -7, 2, "i32") == -1 and calc("/", 1, 0, "i64") is None and calc("*", 2**40, 2**30, "i64") is None


def test_transitions(spark):
    pairs = [("candidate", "confirmed", True), ("confirmed", "candidate", False), ("candidate", "candidate", False), ("rejected", "superseded", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert df.where(S.is_transition(F.col("a"), F.col("b")) != F.col("w")).count() == 0
