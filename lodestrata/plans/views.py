"""Graph views of the driver's tables: the same tables as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import clean_id
from lodestrata.functions.scalars import stable_id
from lodestrata.operators.references import counting_rows
from lodestrata.operators.snapshots import plain_path
from lodestrata.plans.problems import _SQL_PATH, _sql_clean
from lodestrata.runtime import materialize
from lodestrata.sources.tables import table

# ---------------------------------------------------------------- the code graph


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Counting, undeleted entities and framework declarations: id, kind, crate_id, module_path, name, visibility, owner_id."""
    e = counting_rows(table(spark, d, "semantic_entities"), ["kind", "crate_id", "module_path", "name", "visibility", "owner_id", "deleted_at"]).where("deleted_at IS NULL")
    a = e.select(F.col("record_id").alias("id"), "kind", clean_id("crate_id").alias("crate_id"), "module_path", "name", "visibility", clean_id("owner_id").alias("owner_id"))
    f = declarations(spark, d)
    b = f.select("id", F.concat(F.lit("framework."), "role", F.lit("_declaration")).alias("kind"), "crate_id", F.lit(None).cast("string").alias("module_path"), F.col("declared_key_or_target").alias("name"), F.lit(None).cast("string").alias("visibility"), F.col("lexical_owner_id").alias("owner_id"))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti"))


def declarations(spark: SparkSession, d: str) -> DataFrame:
    cols = ["role", "crate_id", "lexical_owner_id", "declared_key_or_target", "epistemic_state", "method", "path", "target_spelling", "local_target_id", "target_binding", "evidence_ids", "repository_identity", "deleted_at"]
    rows = counting_rows(table(spark, d, "framework_declarations"), cols).where("deleted_at IS NULL").withColumnRenamed("record_id", "id").drop("deleted_at")
    for c in ("crate_id", "lexical_owner_id", "local_target_id"):
        rows = rows.withColumn(c, clean_id(c))
    wanted = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce("evidence_ids", F.array().cast("array<string>")), clean_id))))
    return rows.withColumn("evidence_ids", wanted)


def raw_edges(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """Edges as the records name them, dangling or not: id, kind, source, target. ``known``: the entities, if at hand."""
    own = (known if known is not None else entities(spark, d)).where("owner_id IS NOT NULL").select(F.lit("CONTAINS").alias("kind"), F.col("owner_id").alias("source"), F.col("id").alias("target"))
    to = declarations(spark, d).where("local_target_id IS NOT NULL").select(F.lit("RESOLVES_TO").alias("kind"), F.col("id").alias("source"), F.col("local_target_id").alias("target"))
    return own.unionByName(to).select(stable_id("relationship", "kind", "source", "target").alias("id"), "kind", "source", "target")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges whose ends both exist."""
    known = materialize(entities(spark, d).select("id", "owner_id"), "entities")
    return raw_edges(spark, d, known).join(known.select(F.col("id").alias("source")), "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """One claim per declaration: id, subject_id, state, evidence_ids."""
    f = declarations(spark, d)
    return f.select(stable_id("claim", F.lit("entity"), "id", "epistemic_state").alias("id"), F.col("id").alias("subject_id"), F.col("epistemic_state").alias("state"), "evidence_ids")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = counting_rows(table(spark, d, "evidence"), ["path", "blob_oid", "start_byte", "end_byte", "deleted_at"]).where("deleted_at IS NULL")
    return rows.select(F.col("record_id").alias("id"), "path", "blob_oid", "start_byte", "end_byte")


def notes(spark: SparkSession, d: str, name: str, extra: list[str]) -> DataFrame:
    """Counting diagnostics or coverage gaps: id, subject_id, extra columns."""
    rows = counting_rows(table(spark, d, name), ["declaration_id", *extra])
    return rows.select(F.col("record_id").alias("id"), clean_id("declaration_id").alias("subject_id"), *extra)


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d, "framework_diagnostics", ["code"])


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d, "framework_coverage_gaps", ["capability", "state"])


_BEST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1"
_c = _sql_clean


def _urn(family: str, *parts: str) -> str:
    body = " || '\",\"' || ".join(parts)
    return f"('urn:lodestrata:{family}:sha256:' || sha256('[\"' || {body} || '\"]'))"


#: Common table expressions that give the code graph in DuckDB.
CODE = f"""
decl AS (SELECT * EXCLUDE (deleted_at) FROM (
  SELECT {_c('id')} AS id, role, {_c('crate_id')} AS crate_id, {_c('lexical_owner_id')} AS lexical_owner_id, declared_key_or_target, epistemic_state, method, path, target_spelling,
    {_c('local_target_id')} AS local_target_id, target_binding, list_sort(list_distinct([x FOR x IN [{_c('y')} FOR y IN coalesce(evidence_ids, [])] IF x IS NOT NULL])) AS evidence_ids, repository_identity, deleted_at
  FROM framework_declarations WHERE {_c('id')} IS NOT NULL {_BEST.format(_c('id'))}) WHERE deleted_at IS NULL),
ent0 AS (SELECT * EXCLUDE (deleted_at) FROM (
  SELECT {_c('id')} AS id, kind, {_c('crate_id')} AS crate_id, module_path, name, visibility, {_c('owner_id')} AS owner_id, deleted_at
  FROM semantic_entities WHERE {_c('id')} IS NOT NULL {_BEST.format(_c('id'))}) WHERE deleted_at IS NULL),
ent AS (SELECT * FROM ent0 UNION ALL
  SELECT id, 'framework.' || role || '_declaration', crate_id, NULL, declared_key_or_target, NULL, lexical_owner_id FROM decl WHERE id NOT IN (SELECT id FROM ent0)),
rawe0 AS (SELECT 'CONTAINS' AS kind, owner_id AS source, id AS target FROM ent WHERE owner_id IS NOT NULL
  UNION ALL SELECT 'RESOLVES_TO', id, local_target_id FROM decl WHERE local_target_id IS NOT NULL),
rawe AS (SELECT {_urn('relationship', 'kind', 'source', 'target')} AS id, kind, source, target FROM rawe0),
edge AS (SELECT * FROM rawe WHERE source IN (SELECT id FROM ent) AND target IN (SELECT id FROM ent)),
claim AS (SELECT {_urn('claim', "'entity'", 'id', 'epistemic_state')} AS id, id AS subject_id, epistemic_state AS state, evidence_ids FROM decl),
evid AS (SELECT * EXCLUDE (deleted_at) FROM (
  SELECT {_c('id')} AS id, path, blob_oid, start_byte, end_byte, deleted_at FROM evidence WHERE {_c('id')} IS NOT NULL {_BEST.format(_c('id'))}) WHERE deleted_at IS NULL),
diag AS (SELECT {_c('id')} AS id, {_c('declaration_id')} AS subject_id, code FROM framework_diagnostics WHERE {_c('id')} IS NOT NULL {_BEST.format(_c('id'))}),
gap AS (SELECT {_c('id')} AS id, {_c('declaration_id')} AS subject_id, capability, state FROM framework_coverage_gaps WHERE {_c('id')} IS NOT NULL {_BEST.format(_c('id'))})"""

# ---------------------------------------------------------------- the trade graph


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """region, nation, customer, supplier, order and part as a graph: id, kind, source, target."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"))
    parts = [
        edge(table(spark, d, "nation"), "CONTAINS", key("region", "n_regionkey"), key("nation", "n_nationkey")),
        edge(table(spark, d, "customer"), "CONTAINS", key("nation", "c_nationkey"), key("customer", "c_custkey")),
        edge(table(spark, d, "supplier"), "CONTAINS", key("nation", "s_nationkey"), key("supplier", "s_suppkey")),
        edge(table(spark, d, "orders"), "DEFINES", key("customer", "o_custkey"), key("order", "o_orderkey")),
        edge(table(spark, d, "lineitem"), "REFERENCES", key("order", "l_orderkey"), key("part", "l_partkey")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", F.concat_ws("|", "kind", "source", "target"))


TRADE = """
trade AS (SELECT kind || '|' || source || '|' || target AS id, kind, source, target FROM (
  SELECT 'CONTAINS' AS kind, 'region/' || n_regionkey AS source, 'nation/' || n_nationkey AS target FROM nation
  UNION ALL SELECT 'CONTAINS', 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'nation/' || s_nationkey, 'supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 'DEFINES', 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'REFERENCES', 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem))"""

# ---------------------------------------------------------------- revisions of the analysis cache

CACHE_KEY = ["repository_identity", "source_file_id", "canonical_source_path", "source_blob_oid", "crate_id", "canonical_module_path", "language_extractor", "workspace_mapper", "ontology"]


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Counting cache rows: the key's columns, plain path, clean blob, generation, first and last of the repository."""
    rows = table(spark, d, "cache_entries").select(
        "entry_id", *[F.col(f"key.{c}").alias(c) for c in CACHE_KEY if c not in ("canonical_source_path", "source_blob_oid")],
        plain_path(F.col("key.canonical_source_path")).alias("path"), F.lower(F.btrim("key.source_blob_oid")).alias("blob"), "payload_hash", "declaration_count", "generation", "delivered_at",
    )
    latest = rows.groupBy("repository_identity", "generation").agg(F.max("delivered_at").alias("delivered_at"))
    bounds = latest.groupBy("repository_identity").agg(F.min("generation").alias("first"), F.max("generation").alias("last"))
    return rows.join(latest, ["repository_identity", "generation", "delivered_at"]).join(bounds, "repository_identity").drop("delivered_at")


def revision(spark: SparkSession, d: str, which: str) -> DataFrame:
    """The first or last snapshot of every repository, one row per path."""
    rows = cache(spark, d).where(F.col("generation") == F.col(which))
    pick = ["blob", "canonical_module_path", "crate_id", "source_file_id", "language_extractor", "workspace_mapper", "ontology", "payload_hash", "declaration_count"]
    return rows.groupBy("repository_identity", "path").agg(F.max(F.struct(*pick)).alias("r")).select("repository_identity", "path", "r.*")


_PICK = "blob, canonical_module_path, crate_id, source_file_id, language_extractor, workspace_mapper, ontology, payload_hash, declaration_count"
CACHE = f"""
crow AS (SELECT entry_id, key.repository_identity AS repository_identity, key.source_file_id AS source_file_id, {_SQL_PATH.format('key.canonical_source_path')} AS path, lower(trim(key.source_blob_oid)) AS blob, key.crate_id AS crate_id,
  key.canonical_module_path AS canonical_module_path, key.language_extractor AS language_extractor, key.workspace_mapper AS workspace_mapper, key.ontology AS ontology, payload_hash, declaration_count, generation, delivered_at FROM cache_entries),
clat AS (SELECT repository_identity, generation, max(delivered_at) AS delivered_at FROM crow GROUP BY 1, 2),
cbound AS (SELECT repository_identity, min(generation) AS first_gen, max(generation) AS last_gen FROM clat GROUP BY 1),
ccache AS (SELECT c.* FROM crow c JOIN clat l USING (repository_identity, generation, delivered_at)),
old_rev AS (SELECT repository_identity, path, {_PICK} FROM (SELECT c.*, row_number() OVER (PARTITION BY c.repository_identity, path ORDER BY {', '.join(x.strip() + ' DESC NULLS LAST' for x in _PICK.split(','))}) AS rn FROM ccache c JOIN cbound b ON b.repository_identity = c.repository_identity AND c.generation = b.first_gen) WHERE rn = 1),
new_rev AS (SELECT repository_identity, path, {_PICK} FROM (SELECT c.*, row_number() OVER (PARTITION BY c.repository_identity, path ORDER BY {', '.join(x.strip() + ' DESC NULLS LAST' for x in _PICK.split(','))}) AS rn FROM ccache c JOIN cbound b ON b.repository_identity = c.repository_identity AND c.generation = b.last_gen) WHERE rn = 1)"""
