"""Queries that read facts out of source text: parsing in map tasks, everything after it as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import graph, resolve
from lodestrata.operators.snapshots import plain_path
from lodestrata.runtime import materialize
from lodestrata.sources import constants, contracts, manifests, rust
from lodestrata.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    t = table(spark, d, "source_files").select("file_id", plain_path(F.col("canonical_source_path")).alias("path"), "source_text")
    return t.where(F.col("path").endswith(suffix) & F.col("source_text").isNotNull())


def _rust(spark: SparkSession, d: str) -> DataFrame:
    return rust.rust_facts(_texts(spark, d, ".rs"), ["file_id"], "source_text")


def _whole(spark: SparkSession, d: str, key: str = "local_id") -> DataFrame:
    """Rust facts, written once, with ids that are unique over all files."""
    t = materialize(_rust(spark, d), "facts")
    own = lambda c: F.when(F.col(c) != "", F.concat_ws("/", F.col("file_id").cast("string"), F.col(c)))
    return t.withColumn("id", own("local_id")).withColumn("owner_id", own("owner"))


@query
def rust_facts(spark, d):
    """Every fact of every Rust file: declarations, members, callables, calls, controls, bindings, blocks, gaps."""
    return _rust(spark, d)


@query
def rust_kind_counts(spark, d):
    return _rust(spark, d).groupBy(F.when(F.col("kind") == "gap", F.concat(F.lit("gap:"), "name")).otherwise(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"))


@query
def rust_imports(spark, d):
    """Imports with the declaration of the same file they name, if exactly one kind matches."""
    t = _whole(spark, d)
    imports = t.where("kind = 'rust.import'").select(F.col("id").alias("import_id"), F.concat_ws("/", F.col("file_id").cast("string"), F.element_at(F.split("name", "::"), -1)).alias("path"))
    kinds = ["rust.module", "rust.struct", "rust.enum", "rust.trait", "rust.type_alias", "rust.function"]
    names = t.where(F.col("kind").isin(kinds)).select(F.concat_ws("/", F.col("file_id").cast("string"), "name").alias("path"), "kind", "id")
    return resolve.sole_kind(imports, names)


@query
def rust_calls(spark, d):
    """Path calls by resolution: exact module and name in the file, else the file's only function of that name."""
    t = _whole(spark, d)
    spelled = F.col("name").contains("::")
    calls = t.where("kind = 'rust.call_site' AND detail = 'path'").select(
        F.col("id").alias("call_id"), F.col("file_id").cast("string").alias("crate"), F.when(spelled, F.regexp_replace("name", "::[^:]*$", "")).otherwise(F.col("module_path")).alias("module"), F.element_at(F.split("name", "::"), -1).alias("name"), spelled.alias("qualified")
    )
    names = t.where("kind = 'rust.function'").select("id", F.col("file_id").cast("string").alias("crate"), F.col("module_path").alias("module"), "name")
    return resolve.two_tier(calls, names)


@query
def rust_accesses(spark, d):
    """READS and WRITES: each identifier with the narrowest binding of its name whose scope holds it."""
    t = _whole(spark, d)
    uses = t.where("kind = 'rust.expression'").select("owner_id", "name", "id", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "detail")
    start = F.element_at(F.split("detail", ":"), 2).cast("long")
    scopes = t.where("kind = 'rust.pattern_binding'").select("owner_id", "name", "id", start.alias("start"), F.col("ordinal").alias("end"))
    found = resolve.narrowest(resolve.containing(uses, scopes, ["owner_id", "name"]))
    rows = found.join(uses.select(F.col("id").alias("inner_id"), "detail"), "inner_id")
    kinds = F.when(F.col("detail") == "write", F.array(F.lit("WRITES"))).when(F.col("detail") == "read_write", F.array(F.lit("READS"), F.lit("WRITES"))).otherwise(F.array(F.lit("READS")))
    edges = rows.where("NOT shadowed").select(F.explode(kinds).alias("kind"), F.col("inner_id").alias("source"), F.col("outer_id").alias("target"))
    gaps = rows.where("shadowed").select(F.lit("rust.lexical_binding_shadowing").alias("kind"), F.col("inner_id").alias("source"), F.lit(None).cast("string").alias("target"))
    return edges.unionByName(gaps)


def _flow(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks = t.where("kind = 'rust.syntax_basic_block'").select(F.col("owner_id").alias("callable"), F.col("ordinal").alias("block"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("name").alias("role"))
    arcs = t.where("kind = 'flow_edge'").select(F.col("owner_id").alias("callable"), F.col("ordinal").alias("source"), F.col("detail").cast("long").alias("target"), F.col("name").alias("kind"))
    return blocks, arcs


@query
def rust_flow_reaches(spark, d):
    """SYNTAX_REACHES: the strict closure of the flow edges of every supported callable."""
    _, arcs = _flow(_whole(spark, d))
    node = lambda c: F.concat_ws("#", "callable", F.col(c).cast("string"))
    pairs = graph.transitive_closure(arcs.select(node("source").alias("source"), node("target").alias("target")))
    part = lambda c, i: F.split(c, "#")[i]
    return pairs.select(part("source", 0).alias("callable"), part("source", 1).cast("long").alias("source"), part("target", 1).cast("long").alias("target"))


@query
def rust_reaching_definitions(spark, d):
    """Which parameter, let or assignment reaches each read of a supported callable, surely (must) or perhaps (may)."""
    t = _whole(spark, d)
    return _reaching(t, *_flow(t))


def _reaching(t: DataFrame, blocks: DataFrame, arcs: DataFrame) -> DataFrame:
    spot = t.where("kind IN ('rust.expression', 'rust.pattern_binding')").select(F.col("owner_id").alias("callable"), F.col("id").alias("op"), F.col("name").alias("binding"), "kind", "detail", F.col("start_byte").alias("at"), "end_byte", "ordinal")
    inside = spot.join(blocks, "callable").where("start <= at AND end_byte <= end")
    # a read happens where it stands, a write at its statement's end, a parameter before the first block's text
    use = inside.where("kind = 'rust.expression' AND detail IN ('read', 'read_write')").select("callable", "block", (F.col("at") * 2).alias("ordinal"), F.col("op").alias("op_id"), "binding", F.lit("read").alias("kind"))
    done = F.when(F.col("kind") == "rust.expression", F.col("ordinal")).otherwise(F.element_at(F.split("detail", ":"), 2).cast("long"))
    put = inside.where("(kind = 'rust.expression' AND detail IN ('write', 'read_write')) OR (kind = 'rust.pattern_binding' AND detail LIKE 'let:%')").select("callable", "block", (done * 2 + 1).alias("ordinal"), F.concat("op", F.lit("!")).alias("op_id"), "binding", F.lit("write").alias("kind"))
    first = blocks.where("block = 0").select("callable", "block")
    params = spot.where("kind = 'rust.pattern_binding' AND detail LIKE 'parameter:%'").join(first, "callable").select("callable", "block", F.lit(-1).cast("long").alias("ordinal"), F.concat("op", F.lit("!")).alias("op_id"), "binding", F.lit("write").alias("kind"))
    return graph.reaching_definitions(use.unionByName(put).unionByName(params), arcs.select("callable", "source", "target"))


@query
def rust_read_derivations(spark, d):
    """The slice of blocks and the definitions that explain each read of a supported callable."""
    t = _whole(spark, d)
    blocks, arcs = _flow(t)
    reaching = materialize(_reaching(t, blocks, arcs), "reaching")
    spot = t.where("kind IN ('rust.expression', 'rust.pattern_binding')").select(F.col("owner_id").alias("callable"), F.col("id").alias("op"), "kind", "detail", F.col("start_byte").alias("at"), "end_byte")
    inside = spot.join(blocks, "callable").where("start <= at AND end_byte <= end")
    first = blocks.where("block = 0").select("callable", "block")
    params = spot.where("detail LIKE 'parameter:%'").join(first, "callable").select("callable", F.concat("op", F.lit("!")).alias("op_id"), "block")
    places = inside.select("callable", F.col("op").alias("op_id"), "block").unionByName(inside.where("detail NOT LIKE 'parameter:%'").select("callable", F.concat("op", F.lit("!")).alias("op_id"), "block")).unionByName(params).distinct()
    closure = rust_flow_reaches(spark, d)
    return graph.read_derivations(reaching, places, arcs, closure)


@query
def rust_alternatives(spark, d):
    """Declarations of one file, owner, kind and name that stand two or more times under cfg attributes."""
    t = _rust(spark, d).where("detail = 'conditional_unknown'")
    return t.groupBy("file_id", "owner", "kind", "module_path", "name").agg(F.count(F.lit(1)).alias("alternatives"), F.array_sort(F.collect_list("local_id")).alias("members")).where("alternatives >= 2")


@query
def rust_registrations(spark, d):
    """Builder calls and attributes by which a service's parts are declared, with the local function a target names."""
    t = _whole(spark, d)
    rows = t.where("kind IN ('framework.registration', 'framework.candidate')").select(F.col("id").alias("ref_id"), F.col("file_id").cast("string").alias("file"), "name", "detail")
    refs = rows.select("ref_id", "file", F.regexp_extract("detail", r"(\w+)\W*$", 1).alias("target_name"))
    catalog = t.where("kind = 'rust.function'").select("id", F.col("file_id").cast("string").alias("file"), F.col("name").alias("target_name"))
    bound = resolve.trichotomy(refs, catalog, ["file", "target_name"], ("unresolved_external", "resolved_unique", "ambiguous_local"))
    return rows.join(bound, "ref_id").select("ref_id", F.col("name").alias("role"), "detail", "state", "target")


@query
def rust_constants(spark, d):
    """Values of constants and enum variants, evaluated in the order of their dependencies.

    A variant without a value has the one before plus one, from 0. An enum needs a fixed representation; where
    that is missing, or one variant fails, none of its variants has a value.
    """
    t = _whole(spark, d)
    values = t.where("kind = 'rust.declared_value'").select(F.col("owner_id").alias("id"), F.col("detail").alias("expression"))
    consts = t.where("kind IN ('rust.constant', 'rust.static')").select("id", F.concat_ws("/", F.col("file_id").cast("string"), "owner", "module_path").alias("owner"), "name", F.col("detail").alias("primitive")).join(values, "id")
    kinds = t.where("kind = 'rust.enum_representation'").groupBy(F.col("owner_id").alias("owner")).agg(F.max("name").alias("primitive"))
    variants = t.where("kind = 'rust.enum_variant'").select("id", F.col("owner_id").alias("owner"), "name", "ordinal").join(values, "id", "left").join(kinds, "owner", "left")
    given = F.last(F.when(F.col("expression").isNotNull(), F.struct("expression", "ordinal")), True).over(Window.partitionBy("owner").orderBy("ordinal"))
    variants = variants.withColumn("g", given)
    steps = (F.col("ordinal") - F.col("g.ordinal")).cast("string")
    spelled = F.when(F.col("g").isNull(), F.col("ordinal").cast("string")).when(F.col("expression").isNotNull(), F.col("expression")).otherwise(F.concat(F.lit("("), F.col("g.expression"), F.lit(") + "), steps))
    variants = materialize(variants.select("id", "owner", "name", "primitive", spelled.alias("expression")), "variants")
    fixed = variants.where("primitive IS NOT NULL")
    found = materialize(constants.evaluate_constants(consts.unionByName(fixed, allowMissingColumns=True).drop("id")), "constants")
    enums = variants.select("owner").distinct().withColumn("of_enum", F.lit(True))
    failed = found.where("value IS NULL").select("owner").distinct().join(enums, "owner", "left_semi").withColumn("failed", F.lit(True))
    out = found.join(failed, "owner", "left")
    lost = F.coalesce("failed", F.lit(False))
    out = out.select("owner", "name", "primitive", F.when(~lost, F.col("value")).alias("value"), F.when(lost & F.col("problem").isNull(), "another variant failed").otherwise(F.col("problem")).alias("problem"), F.when(~lost, F.col("level")).alias("level"))
    none = variants.where("primitive IS NULL").select("owner", "name", "primitive", F.lit(None).cast("string").alias("value"), F.lit("no fixed representation").alias("problem"), F.lit(None).cast("int").alias("level"))
    return out.unionByName(none)


@query
def cargo_facts(spark, d):
    """Packages, targets, dependencies and features of every manifest."""
    return manifests.cargo_facts(_texts(spark, d, ".toml"), ["file_id"], "source_text")


@query
def contract_facts(spark, d):
    """Operations, response fields and gaps of every JSON or YAML contract; what is no supported contract says why."""
    texts = _texts(spark, d, ".json").unionByName(_texts(spark, d, ".yaml")).unionByName(_texts(spark, d, ".yml"))
    return contracts.openapi_facts(texts, ["file_id"], "source_text")


@query
def client_facts(spark, d):
    """What every Kotlin client assumes of the members of a payload."""
    return contracts.client_facts(_texts(spark, d, ".kt"), ["file_id"], "source_text")


@query
def provider_facts(spark, d):
    return contracts.provider_facts(_texts(spark, d, ".rs"), ["file_id"], "source_text")


@query
def import_expansion(spark, d):
    """Names that the use lines of Rust files bring in, split by expressions alone."""
    lines = _texts(spark, d, ".rs").select("file_id", F.explode(F.split("source_text", "\r?\n")).alias("line")).where(F.col("line").rlike(r"^\s*use [^;]*;\s*$"))
    return lines.select("file_id", F.explode(S.import_paths("line")).alias("u")).select("file_id", "u.path", "u.alias")


#: The same split in SQL: a prefix, then the names between braces or the one without.
SQL["import_expansion"] = r"""WITH f AS (SELECT file_id, unnest(regexp_split_to_array(source_text, '\r?\n')) AS line FROM source_files WHERE source_text IS NOT NULL AND regexp_matches(trim(canonical_source_path), '\.rs$')),
u AS (SELECT file_id, trim(regexp_replace(regexp_replace(line, '^\s*use\s+', ''), ';\s*$', '')) AS t FROM f WHERE regexp_full_match(line, '\s*use [^;]*;\s*')),
p AS (SELECT file_id, CASE WHEN contains(t, '{') THEN regexp_extract(t, '^([^{]*)\{', 1) ELSE '' END AS prefix, unnest(string_split(CASE WHEN contains(t, '{') THEN regexp_extract(t, '\{([^}]*)\}', 1) ELSE t END, ',')) AS n FROM u),
q AS (SELECT file_id, prefix, trim(n) AS n FROM p WHERE trim(n) <> '')
SELECT file_id, CASE WHEN regexp_replace(n, '\s+as\s+.*$', '') = 'self' THEN regexp_replace(prefix, '::$', '') ELSE prefix || regexp_replace(n, '\s+as\s+.*$', '') END AS path, nullif(regexp_extract(n, '\s+as\s+(\w+)$', 1), '') AS alias FROM q"""
