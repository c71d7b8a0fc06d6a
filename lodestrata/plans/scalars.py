"""Queries of the scalar functions, predicates and orders: each over a table, or over a few rows given in the query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import integrity, ordering, reports, store
from lodestrata.plans import views as V
from lodestrata.plans.problems import _SQL_PATH
from lodestrata.sources import rust, scip
from lodestrata.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of the rows that a query over given rows must give."""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def given(spark: SparkSession, column: str, items: list) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"{column} string")


# ---------------------------------------------------------------- text and digests


@query("SELECT item_id, CAST(to_json({'chars': length(text), 'item': item_id, 'suite': coalesce(suite, '')}) AS VARCHAR) AS body FROM eval_items")
def canonical_json(spark, d):
    """Objects as JSON with their members in code-point order of names, whatever the order they are given in."""
    t = table(spark, d, "eval_items")
    return t.select("item_id", S.canonical_json(suite=F.coalesce("suite", F.lit("")), item=F.col("item_id"), chars=F.length("text")).alias("body"))


_ESCAPED = "text"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("`", "&#96;"), ("[", "&#91;"), ("]", "&#93;")):
    _ESCAPED = f"replace({_ESCAPED}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5({_ESCAPED}) AS escaped FROM documents")
def markdown_code(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.markdown_code("text")).alias("escaped"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS squeezed FROM documents")
def squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.squeeze("text")).alias("squeezed"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS composed, nfc_normalize(text) <> text AS changed FROM documents")
def nfc(spark, d):
    t = table(spark, d, "documents").withColumn("n", S.nfc("text"))
    return t.select("doc_id", F.md5("n").alias("composed"), (F.col("n") != F.col("text")).alias("changed"))


@query(f"""WITH {V.CODE} SELECT id, concat_ws(' ', nullif(visibility, ''), CASE WHEN kind = 'rust.function' THEN 'async' END, 'fn ' || name) || '(' || concat_ws(', ', crate_id, kind) || ')' || coalesce(' -> ' || nullif(module_path, ''), '') AS signature FROM ent""")
def display_signature(spark, d):
    """A signature put together from its parts, where none is declared; missing parts leave no gap."""
    qualifiers = F.array_compact(F.array(F.when(F.col("kind") == "rust.function", "async")))
    parameters = F.array("crate_id", "kind")
    return V.entities(spark, d).select("id", S.display_signature(F.lit(None).cast("string"), F.col("visibility"), qualifiers, F.col("name"), parameters, F.col("module_path")).alias("signature"))


@query("SELECT doc_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM documents")
def rfc3339(spark, d):
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000
    return table(spark, d, "documents").select("doc_id", S.rfc3339(F.floor(seconds)).alias("at"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256(text) END AS sha256, CASE WHEN text IS NOT NULL THEN md5(text) END AS md5, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"))


# ---------------------------------------------------------------- positions


@query("""WITH t AS (SELECT doc_id, text, left(text, CAST(n_chars // 2 AS INTEGER)) AS head FROM documents WHERE text IS NOT NULL AND n_chars > 0)
SELECT doc_id, CAST(strlen(head) AS BIGINT) AS byte_offset, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(list_extract(string_split(head, chr(10)), -1)) + 1 AS BIGINT) AS col FROM t""")
def utf8_line_col(spark, d):
    """Line and column of the byte offset in the middle of texts of any script."""
    t = table(spark, d, "documents").where("text IS NOT NULL AND n_chars > 0")
    at = F.octet_length(F.left("text", F.floor(F.col("n_chars") / 2).cast("int"))).cast("long")
    p = S.line_column(F.encode("text", "UTF-8"), F.col("byte_offset"))
    return t.select("doc_id", "text", at.alias("byte_offset")).select("doc_id", "byte_offset", p.alias("p")).select("doc_id", "byte_offset", F.col("p.line").alias("line"), F.col("p.column").alias("col"))


@query("SELECT doc_id, strlen(left(text, 1)) = 1 AS second_byte, strlen(left(text, 1)) = 2 OR (strlen(left(text, 1)) = 1 AND strlen(left(text, 2)) = 2) AS third_byte FROM documents WHERE strlen(text) >= 3")
def char_boundary(spark, d):
    """Whether the second and third byte of a text begin a character."""
    t = table(spark, d, "documents").where("octet_length(text) >= 3").withColumn("b", F.encode("text", "UTF-8"))
    at = lambda n: S.is_char_boundary(F.col("b"), F.lit(n))
    return t.select("doc_id", at(1).alias("second_byte"), at(2).alias("third_byte"))


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, l, len(l) // 2 AS n FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(coalesce(list_sum([strlen(x) + 1 FOR x IN l[1:n]]), 0) + strlen(left(l[n + 1], 3)) AS BIGINT) AS byte_offset FROM k""")
def byte_offset(spark, d):
    """The byte offset of the third character of a text's middle line."""
    t = table(spark, d, "documents").where("text IS NOT NULL").withColumn("line", F.floor(F.size(F.split("text", "\n", -1)) / 2).cast("long"))
    return t.select("doc_id", "line", S.byte_offset(F.col("text"), F.col("line"), F.lit(3)).alias("byte_offset"))


@query("SELECT file_id, array_to_string(string_split(source_text, chr(10))[2:4], chr(10)) AS lines FROM source_files WHERE source_text IS NOT NULL")
def excerpt_lines(spark, d):
    return table(spark, d, "source_files").where("source_text IS NOT NULL").select("file_id", S.excerpt_lines(F.col("source_text"), F.lit(2), F.lit(4)).alias("lines"))


# ---------------------------------------------------------------- paths, pointers, validators

_PATHS = [("a/b.rs", "a/b.rs"), ("./a//b", "a/b"), ("a/../b", "b"), ("a/b/../../c", "c"), ("../a", None), ("a/../../b", None), ("/a", None), ("a\\b", None), ("", ""), (".", "")]


@query(values("path, normal", _PATHS))
def normal_path(spark, d):
    return given(spark, "path", [p for p, _ in _PATHS]).select("path", S.normal_path("path").alias("normal"))


@query(f"""WITH f AS (SELECT file_id, {_SQL_PATH.format('canonical_source_path')} AS path FROM source_files)
SELECT file_id, '/' || replace(replace(path, '~', '~0'), '/', '~1') AS pointer, path IS NOT NULL AS valid FROM f""")
def json_pointer(spark, d):
    """A path as one part of a JSON pointer, which is always a valid one."""
    from lodestrata.operators.snapshots import plain_path

    p = F.concat(F.lit("/"), S.pointer_escape(plain_path(F.col("canonical_source_path"))))
    return table(spark, d, "source_files").select("file_id", p.alias("pointer"), F.coalesce(S.is_json_pointer(p), F.lit(False)).alias("valid"))


@query(f"""WITH {V.CODE}, q AS (SELECT id, '"' || regexp_replace(path, '\\{{(\\w+)\\}}', '$\\1', 'g') || '"' AS quoted FROM decl WHERE path IS NOT NULL), b AS (SELECT *, regexp_extract(quoted, '^"(/[^"]*)"$', 1) AS bare FROM q)
SELECT id, quoted, CASE WHEN bare <> '' AND NOT regexp_matches(bare, '[{{}}\\\\]|//') AND (bare = '/' OR bare NOT LIKE '%/') THEN regexp_replace(bare, '\\$([A-Za-z_][A-Za-z0-9_]*)', '{{\\1}}', 'g') END AS http_path FROM b""")
def http_path(spark, d):
    """Path templates as clients write them ("/a/$id"), back in the form of a contract."""
    q = F.concat(F.lit('"'), F.regexp_replace("path", r"\{(\w+)\}", r"\$$1"), F.lit('"'))
    return V.declarations(spark, d).where("path IS NOT NULL").select("id", q.alias("quoted")).select("id", "quoted", S.http_path("quoted").alias("http_path"))


@query(r"""SELECT file_id, canonical_source_path <> '' AND NOT regexp_matches(canonical_source_path, '[\\\x00-\x1f\x7f]') AND NOT list_has_any(string_split(canonical_source_path, '/'), ['', '.', '..']) AS safe FROM source_files""")
def path_safety(spark, d):
    return table(spark, d, "source_files").select("file_id", S.is_safe_path("canonical_source_path").alias("safe"))


@query("""SELECT regexp_full_match(key.source_blob_oid, '[0-9a-f]{40}') AS is_oid, key.source_blob_oid IS NULL AS is_null, count(*) AS n FROM cache_entries GROUP BY ALL""")
def object_id_shape(spark, d):
    """How many object ids are written in the plain form."""
    oid = F.col("key.source_blob_oid")
    return table(spark, d, "cache_entries").groupBy(S.is_object_id(oid).alias("is_oid"), oid.isNull().alias("is_null")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.CODE} SELECT id, path, regexp_full_match(path, '((/([A-Za-z0-9._~-]+|\\{{[A-Za-z_][A-Za-z0-9_]*\\}}))+|/)') AS is_template, regexp_full_match(declared_key_or_target, '[A-Za-z_][A-Za-z0-9_.-]*') AS is_name, regexp_full_match(repository_identity, '[a-z0-9]([a-z0-9.-]*[a-z0-9])?(:[0-9]{{1,5}})?') AS is_authority FROM decl""")
def path_template(spark, d):
    """Whether a path is a template, a key an operation's name, and an identity a host with an optional port."""
    return V.declarations(spark, d).select("id", "path", S.is_path_template("path").alias("is_template"), S.is_operation_name("declared_key_or_target").alias("is_name"), S.is_authority("repository_identity").alias("is_authority"))


@query(f"""WITH {V.CODE} SELECT id, target_spelling, regexp_matches(list_extract(string_split(target_spelling, '::'), -1), '^[A-Z]') AS constructor FROM decl WHERE target_spelling IS NOT NULL""")
def constructor_filter(spark, d):
    """Calls whose last segment is spelled like a type build a value: they are no calls of functions."""
    return V.declarations(spark, d).where("target_spelling IS NOT NULL").select("id", "target_spelling", S.is_constructor("target_spelling").alias("constructor"))


@query("SELECT item_id, suite FROM eval_items")
def row_limit(spark, d):
    """A table within its limit comes out whole; one beyond is refused, never cut."""
    return integrity.within_limit(table(spark, d, "eval_items").select("item_id", "suite"), 1_000_000, "eval_items")


@query(values("field", [("key.source_blob_oid",), ("payload_hash",)]))
def privacy_fields(spark, d):
    """Fields, at any depth, whose names are on a list of those that may not be published."""
    return given(spark, "field", integrity.denied_fields(table(spark, d, "cache_entries").schema, {"source_blob_oid", "payload_hash", "author"}))


# ---------------------------------------------------------------- literals and small grammars

_INTEGERS = [("42", "+", 10, "42", None), ("-0xFF_u8", "-", 16, "ff", "u8"), ("0b1010", "+", 2, "1010", None), ("0o17i64", "+", 8, "17", "i64"), ("1_000usize", "+", 10, "1000", "usize"), ("1.5", None, None, None, None), ("0x", None, None, None, None), ("abc", None, None, None, None)]


@query(values("text, sign, radix, digits, suffix", _INTEGERS))
def integer_literal(spark, d):
    return given(spark, "text", [r[0] for r in _INTEGERS]).select("text", S.integer_literal("text").alias("v")).select("text", "v.sign", "v.radix", "v.digits", "v.suffix")


_QUOTED = [('"a\\tb"', "a\tb"), ('r#"x"y"#', 'x"y'), ("'\\''", "'"), ("b'\\x41'", "A"), ('"\\u{e9}"', "é"), ('"\\q"', None), ("plain", None)]


@query(values("quoted, decoded", _QUOTED))
def quoted_literal(spark, d):
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(rust.decode_literal)

    return given(spark, "quoted", [q for q, _ in _QUOTED]).select("quoted", decode("quoted").alias("decoded"))


_SYMBOLS = [("rust cargo own 1.0 a/f().", "rust", "cargo", "own", "1.0", "a/f().", False, "cargo own 1.0"), ("local 12", None, None, None, None, None, True, None), ("x . . . T#", "x", ".", ".", ".", "T#", False, ". . .")]


@query(values("symbol, scheme, manager, package, version, descriptors, is_local, whole_package", _SYMBOLS))
def scip_symbol(spark, d):
    """A compiler index symbol's parts, and the package it belongs to."""
    t = given(spark, "symbol", [r[0] for r in _SYMBOLS]).withColumn("v", S.scip_symbol("symbol"))
    return t.select("symbol", "v.scheme", "v.manager", "v.package", "v.version", "v.descriptors", F.col("v.local").alias("is_local"), scip.package_of("symbol").alias("whole_package"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS roles, (CAST(l_partkey AS BIGINT) & 1) <> 0 AS definition, (CAST(l_partkey AS BIGINT) & 2) <> 0 AS import, (CAST(l_partkey AS BIGINT) & 8) <> 0 AS read, (CAST(l_partkey AS BIGINT) & 16) <> 0 AS generated FROM lineitem")
def role_bits(spark, d):
    """The four role bits of an occurrence, on part keys taken as bits."""
    bits = S.symbol_roles(F.col("roles"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("roles")).select("*", *[bits[n].alias(n) for n in ("definition", "import", "read", "generated")])


_MEMBERS = [("dep:serde", "dependency", "serde", None, False), ("serde/std", "dependency_feature", "serde", "std", False), ("serde?/std", "dependency_feature", "serde", "std", True), ("full", "feature", None, "full", False)]


@query(values("member, kind, dependency, feature, weak", _MEMBERS))
def feature_member(spark, d):
    return given(spark, "member", [r[0] for r in _MEMBERS]).select("member", S.feature_member("member").alias("v")).select("member", "v.kind", "v.dependency", "v.feature", "v.weak")


_SIGNATURES = [
    ("pub fn a(&self)", "public", "shared_reference", None), ("pub(crate) fn b(&mut self, x: u8)", "restricted:crate", "mutable_reference", None), ("fn c(self)", "private", "value", None),
    ('pub unsafe extern "C" fn d(x: u8)', "public", "none", "C"), ("extern fn e()", "private", "none", "C"), ("fn f(self: Box<Self>)", "private", "typed", None), ("fn g(&'a mut self)", "private", "mutable_reference", None), ("pub fn h(mut self)", "public", "value", None),
]


@query(values("text, visibility, receiver, abi", _SIGNATURES))
def signature_parts(spark, d):
    """Visibility, receiver and binary interface of a declared signature."""
    return given(spark, "text", [r[0] for r in _SIGNATURES]).select("text", S.visibility("text").alias("visibility"), S.receiver("text").alias("receiver"), S.abi("text").alias("abi"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a & b AS both, a | b AS any_of, xor(a, b) AS either, -a AS minus, -a - 1 AS flipped, CASE WHEN a <= 127 THEN a & b END AS narrow FROM t""")
def checked_bits(spark, d):
    """Bitwise and, or, exclusive or, negation and complement of checked integers; out of range gives null."""
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    on = lambda op, t: S.checked(op, a, b, F.lit(t)).cast("long")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", on("&", "i64").alias("both"), on("|", "i64").alias("any_of"), on("^", "i64").alias("either"), S.negated(a, F.lit("i64")).cast("long").alias("minus"), S.complement(a, F.lit("i64")).cast("long").alias("flipped"),
        F.when(S.in_range(a.cast("decimal(38,0)"), F.lit("i8")), on("&", "i64")).alias("narrow"),
    )


_EDGES = [
    ("i8", "-128", "-1", None, "-1", "-128", None, "127"), ("u8", "200", "55", "255", "255", "0", None, "55"), ("u64", "18446744073709551615", "1", None, "18446744073709551615", "1", None, "0"),
    ("i64", "9223372036854775807", "1", None, "9223372036854775807", "1", "-9223372036854775807", "-9223372036854775808"), ("usize", "1", "1", None, None, None, None, None),
]


@query(values('type, a, b, total, any_of, common, minus, flipped', _EDGES))
def checked_limits(spark, d):
    """Checked arithmetic at the limits of the types; a type that is not evaluated gives null."""
    t = spark.createDataFrame([r[:3] for r in _EDGES], "type string, a string, b string")
    x, y, p = F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)"), F.col("type")
    out = {"total": S.checked("+", x, y, p), "any_of": S.checked("|", x, y, p), "common": S.checked("&", x, y, p), "minus": S.negated(x, p), "flipped": S.complement(x, p)}
    return t.select("type", "a", "b", *[v.cast("string").alias(k) for k, v in out.items()])


# ---------------------------------------------------------------- maps, arrays, orders


@query("SELECT DISTINCT id, recorded_at, unnest(map_keys(properties)) AS name, unnest(map_values(properties)) AS value FROM semantic_entities")
def property_values(spark, d):
    """Every property of an entity's rows by its name."""
    t = table(spark, d, "semantic_entities").select("id", "recorded_at", "properties", F.explode(F.map_keys("properties")).alias("name"))
    return t.select("id", "recorded_at", "name", F.try_element_at("properties", F.col("name")).alias("value")).distinct()


@query("""SELECT id, recorded_at, ingested_at, array_to_string(list_sort(list_distinct([x FOR x IN evidence_ids IF x IS NOT NULL])), ',') AS ids, coalesce(list_contains(evidence_ids, evidence_ids[1]), false) AS holds_first FROM framework_declarations WHERE evidence_ids IS NOT NULL""")
def sorted_unique(spark, d):
    """Arrays of ids, sorted and each once; whether they hold their own first id."""
    a = F.col("evidence_ids")
    t = table(spark, d, "framework_declarations").where("evidence_ids IS NOT NULL")
    first = F.try_element_at(a, F.lit(1))
    return t.select("id", "recorded_at", "ingested_at", F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",").alias("ids"), F.coalesce(F.array_contains(a, first), F.lit(False)).alias("holds_first"))


@query("SELECT row_number() OVER (ORDER BY suite, item_id) AS line, CAST(to_json({'item_id': item_id, 'suite': suite}) AS VARCHAR) AS value FROM eval_items")
def canonical_order(spark, d):
    """The lines of an export with their numbers: ordered by suite, then id, each a JSON object with sorted members."""
    t = ordering.global_ordinal(table(spark, d, "eval_items").select("suite", "item_id"), ["suite", "item_id"], "line")
    lines = store.canonical_lines(t.select("suite", "item_id", "line"), "line", keep=["line"])
    return lines.select("line", "value")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, doc_id) AS place FROM documents")
def nulls_first_order(spark, d):
    w = Window.partitionBy("source").orderBy(F.col("lang").asc_nulls_first(), "doc_id")
    return table(spark, d, "documents").select("doc_id", F.row_number().over(w).alias("place"))


@query("SELECT family, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT id) AS ids FROM (SELECT 'nation' AS family, CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region) GROUP BY 1")
def report_rows(spark, d):
    """The families of a report as one table of JSON bodies: how many rows and ids it holds of each."""
    r = reports.report({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, {"nation": "n_nationkey", "region": "r_regionkey"})
    return r.where("body LIKE '{%'").groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
