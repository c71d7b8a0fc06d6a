"""Queries of the general data problems over the driver's tables, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import clean_id, id16, micros
from lodestrata.operators import drift, hierarchy, loglines, references, snapshots
from lodestrata.operators.skew import hot_keys
from lodestrata.runtime import materialize
from lodestrata.sources.tables import table

# ---------------------------------------------------------------- 1: references

DECLARATIONS, DIAGNOSTICS, GAPS = "framework_declarations", "framework_diagnostics", "framework_coverage_gaps"
EVIDENCE, ENTITIES = "evidence", "semantic_entities"


def _month() -> F.Column:
    return F.date_format("recorded_at", "yyyy-MM")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """All references of the counting, undeleted records: src_table, record_id, ref_field, target, ref_id, times."""
    decl = references.counting_rows(table(spark, d, DECLARATIONS), ["deleted_at", "evidence_ids", "local_target_id"]).where("deleted_at IS NULL")
    wanted = F.array_distinct(F.array_compact(F.transform(F.coalesce("evidence_ids", F.array().cast("array<string>")), clean_id)))
    named = [F.transform(wanted, lambda x: F.struct(F.lit("evidence_ids").alias("ref_field"), F.lit(EVIDENCE).alias("target"), x.alias("ref_id")))]
    local = clean_id("local_target_id")
    named.append(F.when(local.isNotNull(), F.array(F.struct(F.lit("local_target_id").alias("ref_field"), F.lit(ENTITIES).alias("target"), local.alias("ref_id")))).otherwise(F.array().cast("array<struct<ref_field:string,target:string,ref_id:string>>")))
    out = decl.select(F.lit(DECLARATIONS).alias("src_table"), "record_id", "recorded_at", F.explode(F.concat(*named)).alias("r"))
    out = out.select("src_table", "record_id", "r.*", "recorded_at")
    for name in (DIAGNOSTICS, GAPS):
        rows = references.counting_rows(table(spark, d, name), ["declaration_id"])
        out = out.unionByName(
            rows.select(F.lit(name).alias("src_table"), "record_id", F.lit("declaration_id").alias("ref_field"), F.lit(DECLARATIONS).alias("target"), clean_id("declaration_id").alias("ref_id"), "recorded_at")
        )
    return out.withColumn("__at", micros("recorded_at"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in (EVIDENCE, ENTITIES, DECLARATIONS):
        rows = table(spark, d, name).select(clean_id("id").alias("ref_id"), "recorded_at", "deleted_at").where("ref_id IS NOT NULL")
        part = references.target_states(rows, ["ref_id"]).withColumn("target", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _raw_keys(spark: SparkSession, d: str) -> DataFrame:
    """The reference keys as they stand in the tables, for the skew sketch only: no shuffle."""
    decl = table(spark, d, DECLARATIONS)
    out = decl.select(F.lit(EVIDENCE).alias("t"), F.explode("evidence_ids").alias("id")).unionByName(decl.select(F.lit(ENTITIES).alias("t"), F.col("local_target_id").alias("id")))
    for name in (DIAGNOSTICS, GAPS):
        out = out.unionByName(table(spark, d, name).select(F.lit(DECLARATIONS).alias("t"), F.col("declaration_id").alias("id")))
    return out.select(id16(F.concat_ws("\x1f", "t", clean_id("id"))).alias("k"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hot = hot_keys(_raw_keys(spark, d), F.col("k"))
    found = references.find_orphans(_references(spark, d), _targets(spark, d), ["target", "ref_id"], "__at", "simple", hot, F.col("record_id"))
    return found.select("src_table", "record_id", "ref_field", "ref_id", "status", _month().alias("period"))


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """A declaration's (crate, owner) as one reference to an entity of that crate: parts may be null, those that are there must agree with some entity."""
    rows = references.counting_rows(table(spark, d, DECLARATIONS), ["crate_id", "lexical_owner_id", "deleted_at"]).where("deleted_at IS NULL")
    refs = rows.select("record_id", clean_id("crate_id").alias("crate_id"), clean_id("lexical_owner_id").alias("owner"), micros("recorded_at").alias("__at"))
    ents = table(spark, d, ENTITIES).select(clean_id("crate_id").alias("crate_id"), clean_id("id").alias("owner"), "recorded_at", "deleted_at")
    keyed = table(spark, d, DECLARATIONS).select(id16(F.concat_ws("\x1f", clean_id("crate_id"), clean_id("lexical_owner_id"))).alias("k"))
    found = references.find_orphans(refs, references.target_states(ents, ["crate_id", "owner"]), ["crate_id", "owner"], "__at", "partial", hot_keys(keyed, F.col("k")), F.col("record_id"))
    return found.select("record_id", "crate_id", "owner", "status")


def p1_by_table_and_period(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("src_table", "ref_field", "period", "status").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("record_id").alias("records"))


_CLEAN = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '')"


def _sql_clean(c: str) -> str:
    return _CLEAN.format(c)


def _p1_sql() -> str:
    c = _sql_clean
    return f"""
WITH decl AS (
  SELECT {c('id')} AS record_id, recorded_at, deleted_at, evidence_ids, local_target_id
  FROM framework_declarations WHERE {c('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {c('id')} ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
diag AS (
  SELECT {c('id')} AS record_id, recorded_at, declaration_id FROM framework_diagnostics WHERE {c('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {c('id')} ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
gap AS (
  SELECT {c('id')} AS record_id, recorded_at, declaration_id FROM framework_coverage_gaps WHERE {c('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {c('id')} ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
ev AS (SELECT DISTINCT record_id, recorded_at, {c('u')} AS ref_id FROM (SELECT record_id, recorded_at, unnest(evidence_ids) AS u FROM decl WHERE deleted_at IS NULL)),
refs AS (
  SELECT 'framework_declarations' AS src_table, record_id, 'evidence_ids' AS ref_field, 'evidence' AS target, ref_id, recorded_at FROM ev
  UNION ALL SELECT 'framework_declarations', record_id, 'local_target_id', 'semantic_entities', {c('local_target_id')}, recorded_at FROM decl WHERE deleted_at IS NULL
  UNION ALL SELECT 'framework_diagnostics', record_id, 'declaration_id', 'framework_declarations', {c('declaration_id')}, recorded_at FROM diag
  UNION ALL SELECT 'framework_coverage_gaps', record_id, 'declaration_id', 'framework_declarations', {c('declaration_id')}, recorded_at FROM gap),
rows_ AS (
  SELECT 'evidence' AS target, {c('id')} AS ref_id, recorded_at, deleted_at FROM evidence
  UNION ALL SELECT 'semantic_entities', {c('id')}, recorded_at, deleted_at FROM semantic_entities
  UNION ALL SELECT 'framework_declarations', {c('id')}, recorded_at, deleted_at FROM framework_declarations),
tgt AS (
  SELECT target, ref_id, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, max(CASE WHEN deleted_at IS NOT NULL THEN recorded_at END) AS gone
  FROM rows_ WHERE ref_id IS NOT NULL GROUP BY target, ref_id),
judged AS (
  SELECT r.*, CASE WHEN t.ref_id IS NULL THEN 'missing' WHEN t.gone = t.last_seen THEN 'deleted' WHEN t.first_seen > r.recorded_at THEN 'late' END AS status
  FROM refs r LEFT JOIN tgt t ON t.target = r.target AND t.ref_id = r.ref_id WHERE r.ref_id IS NOT NULL),
found AS (
  SELECT src_table, record_id, ref_field, ref_id, status, strftime(recorded_at, '%Y-%m') AS period FROM judged WHERE status IS NOT NULL)
"""


# ---------------------------------------------------------------- 2: drift

#: The members of the two record families and their JSON types.
OBSERVATION = {
    "schema_version": "string", "requirement": "string", "slice": "string", "risk": "string", "static_adapter": "string",
    "correction_round": "integer", "contract_bundle_sha256": "string", "test_only_head": "string", "command": "string",
    "runner_exit_code": "integer", "expected_failure": "string", "actual_failure": "string", "failed_for_expected_reason": "boolean",
    "raw_log_path": "string", "raw_log_bytes": "integer", "raw_log_sha256": "string", "environment.os": "string",
    "environment.rustc": "string", "environment.observed_at_utc": "string", "progression.commit_oid": "string",
    "changed_paths": "array", "limitation": "string",
}
PORTABLE_GRAPH = {
    "repository.identity": "string", "repository.commit_oid": "string", "repository.tree_oid": "string",
    "source_snapshot.snapshot_id": "string", "source_snapshot.schema_version": "string", "source_snapshot.semantic_hash": "string",
    "ontology_version": "string", "query_contract_version": "string", "projection.final_profile": "string",
    "entities": "array", "relationships": "array", "claims": "array", "document_count": "integer", "canonical_bytes": "integer", "truncated": "boolean",
}
TARGET = OBSERVATION | PORTABLE_GRAPH


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    return drift.ingest(table(spark, d, "raw_records"), TARGET)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records")
    base = materialize(drift.ingest(raw.select("stream", "file_no", "subject_key", "body"), TARGET).drop("broken_body"), "ingested")
    return drift.field_changes(drift.field_values(base, TARGET, ["stream", "file_no", "subject_key"]), raw)


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent table: typed columns, and what doesn't fit as JSON."""
    return _ingested(spark, d).withColumn("rescued", drift.rescued_json())


def p2_promoted(spark: SparkSession, d: str) -> DataFrame:
    """The table after renamed fields were replayed from the rescue column: those whose values the files themselves show to be the same."""
    approved = drift.approved_renames(p2_found(spark, d), TARGET)
    return drift.promote(_ingested(spark, d), approved).withColumn("rescued", drift.rescued_json())


# ---------------------------------------------------------------- 3: hierarchies


def _forest(spark: SparkSession, d: str, name: bool = False) -> DataFrame:
    """One row per id of both tables: its counting row's owner (and display name)."""
    parts = None
    for t, owner, label in ((ENTITIES, "owner_id", "name"), (DECLARATIONS, "lexical_owner_id", "declared_key_or_target")):
        rows = table(spark, d, t).select("id", F.col(owner).alias("parent"), "recorded_at", "ingested_at", *([F.col(label).alias("name")] if name else []))
        parts = rows if parts is None else parts.unionByName(rows)
    rows = references.counting_rows(parts.withColumn("parent", clean_id("parent")), ["parent", *(["name"] if name else [])])
    return rows.select(F.col("record_id").alias("id"), "parent", *(["name"] if name else []))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_forest(spark, d)).select(F.col("id").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of names from the root, for every node that has one."""
    tree = hierarchy.resolve(_forest(spark, d, name=True), with_path=True, label="name")
    return tree.select(F.col("id").alias("node_id"), F.concat_ws("/", "path").alias("full_path"), "depth", F.coalesce("root", F.lit("")).alias("root_id"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, d)).where("distance > 0")


def p3_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_descendants(spark, d).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))


_P3_TREE = f"""
rows_ AS (
  SELECT {_sql_clean('id')} AS id, {_sql_clean('owner_id')} AS parent, name, recorded_at, ingested_at FROM semantic_entities
  UNION ALL SELECT {_sql_clean('id')}, {_sql_clean('lexical_owner_id')}, declared_key_or_target, recorded_at, ingested_at FROM framework_declarations),
nodes AS (
  SELECT id, parent, coalesce(name, id) AS seg FROM rows_ WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
tree AS (
  SELECT n.id, n.id AS root, 0 AS depth, n.seg AS path, [n.id] AS ids FROM nodes n LEFT JOIN nodes p ON p.id = n.parent WHERE p.id IS NULL
  UNION ALL
  SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.seg, list_append(t.ids, n.id) FROM tree t JOIN nodes n ON n.parent = t.id)
"""


def _p3_sql() -> str:
    return f"""
WITH RECURSIVE {_P3_TREE.strip()},
stuck AS (SELECT n.id, n.parent FROM nodes n WHERE n.id NOT IN (SELECT id FROM tree)),
walk AS (
  SELECT id AS start_id, parent AS here FROM stuck
  UNION
  SELECT w.start_id, s.parent FROM walk w JOIN stuck s ON s.id = w.here),
ring AS (SELECT DISTINCT start_id AS id FROM walk WHERE start_id = here)
SELECT id AS node_id, root AS root_id, depth FROM tree
UNION ALL SELECT s.id, '', CASE WHEN r.id IS NULL THEN -2 ELSE -1 END FROM stuck s LEFT JOIN ring r ON r.id = s.id
"""


# ---------------------------------------------------------------- 4: snapshots


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cache_entries").select(
        F.col("key.repository_identity").alias("repository_identity"), "generation", "delivered_at",
        snapshots.plain_path(F.col("key.canonical_source_path")).alias("source_path"), F.col("key.source_blob_oid").alias("blob"),
    )
    return snapshots.snapshot_changes(rows, "repository_identity", "generation", "delivered_at", "source_path", F.lower(F.btrim("blob")))


def p4_against_plans(spark: SparkSession, d: str) -> DataFrame:
    """Per refresh plan, how far the producer's changed_paths agree with the changes derived from the snapshots."""
    plans = table(spark, d, "refresh_plans").select("plan_id", "repository_identity", F.col("target_generation").alias("generation"), "changed_paths")
    claimed = (
        plans.select("plan_id", "repository_identity", "generation", F.explode("changed_paths").alias("c"))
        .select("plan_id", "repository_identity", "generation", snapshots.plain_path(F.col("c.path")).alias("source_path"))
        .where("source_path IS NOT NULL").distinct().withColumn("claimed", F.lit(1))
    )
    found = p4_found(spark, d).join(plans.select("plan_id", "repository_identity", "generation"), ["repository_identity", "generation"]).select("plan_id", "source_path", F.lit(1).alias("found"))
    both = claimed.select("plan_id", "source_path", "claimed").join(found, ["plan_id", "source_path"], "full_outer")
    counts = both.groupBy("plan_id").agg(
        F.count(F.when(F.col("claimed").isNotNull() & F.col("found").isNotNull(), 1)).alias("agreed"),
        F.count(F.when(F.col("found").isNull(), 1)).alias("claimed_only"),
        F.count(F.when(F.col("claimed").isNull(), 1)).alias("found_only"),
    )
    none = F.lit(0).cast("long")
    return plans.select("plan_id", "repository_identity", "generation").join(counts, "plan_id", "left").select(
        "plan_id", "repository_identity", "generation", *[F.coalesce(c, none).alias(c) for c in ("agreed", "claimed_only", "found_only")]
    )


_SQL_PATH = r"regexp_replace(regexp_replace(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\/]+', '/', 'g'), '^(\./)+', '')"

_P4_CTES = f"""
base AS (
  SELECT key.repository_identity AS g, generation AS v, delivered_at AS ts, {_SQL_PATH.format('key.canonical_source_path')} AS k, lower(trim(key.source_blob_oid)) AS b FROM cache_entries),
latest AS (SELECT g, v, max(ts) AS ts FROM base GROUP BY g, v),
seq AS (SELECT g, v, ts, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM latest WINDOW w AS (PARTITION BY g ORDER BY v)),
snap AS (SELECT b.g, b.v, s.pv, s.nv, b.k, list_sort(list(DISTINCT coalesce('blob ' || b.b, 'none'))) AS b FROM base b JOIN seq s ON s.g = b.g AND s.v = b.v AND s.ts = b.ts WHERE b.k IS NOT NULL GROUP BY ALL),
p4 AS (
  SELECT n.g AS repository_identity, n.v AS generation, n.k AS source_path, CASE WHEN o.k IS NULL THEN 'added' ELSE 'modified' END AS change_kind
  FROM snap n LEFT JOIN snap o ON o.g = n.g AND o.v = n.pv AND o.k = n.k
  WHERE n.pv IS NOT NULL AND (o.k IS NULL OR o.b IS DISTINCT FROM n.b)
  UNION ALL
  SELECT o.g, o.nv, o.k, 'deleted' FROM snap o LEFT JOIN snap n ON n.g = o.g AND n.v = o.nv AND n.k = o.k WHERE o.nv IS NOT NULL AND n.k IS NULL)
"""

# ---------------------------------------------------------------- 5: log lines


def log_sources(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the log files and of the root causes: source, line_no, text, not_after."""
    files = table(spark, d, "log_lines").select(F.col("raw_log_path").alias("source"), "line_no", F.col("line_text").alias("text"), F.col("collected_at").alias("not_after"))
    causes = table(spark, d, "ci_failures").select(F.concat(F.lit("root_cause:"), F.col("failure_id").cast("string")).alias("source"), "root_cause", "recorded_at")
    return files.unionByName(loglines.split_lines(causes, "source", "root_cause", "recorded_at"))


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return loglines.entries(log_sources(spark, d)).withColumnRenamed("source", "entry_source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_entries(spark, d).drop("message")


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    """Entries per component and level, with the lines they hold."""
    return p5_entries(spark, d).groupBy("component", "entry_level").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("lines"))


QUERIES = {
    "p1_found": p1_found, "p1_composite": p1_composite, "p1_by_table_and_period": p1_by_table_and_period,
    "p2_found": p2_found, "p2_table": p2_table, "p2_promoted": p2_promoted,
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_descendant_counts": p3_descendant_counts,
    "p4_found": p4_found, "p4_against_plans": p4_against_plans,
    "p5_found": p5_found, "p5_entries": p5_entries, "p5_levels": p5_levels,
}

_NEVER = "TIMESTAMP '0001-01-01'"

#: The same change list from the bodies' JSON trees: no rescue column, no digests.
_P2_SQL = r"""WITH RECURSIVE rec AS (SELECT record_id, stream, file_no, subject_key, CAST(body AS JSON) AS j FROM raw_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
walk AS (
  SELECT record_id, stream, file_no, subject_key, k AS path, json_extract(j, '$."' || replace(k, '"', '\"') || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM rec)
  UNION ALL
  SELECT record_id, stream, file_no, subject_key, path || '.' || k, json_extract(v, '$."' || replace(k, '"', '\"') || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT')),
val AS (
  SELECT DISTINCT stream, file_no, subject_key, path, CAST(v AS VARCHAR) AS value,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind
  FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'NULL')),
files AS (SELECT DISTINCT stream, file_no FROM raw_records WHERE stream IS NOT NULL AND file_no IS NOT NULL),
ord AS (SELECT stream, file_no, lag(file_no) OVER (PARTITION BY stream ORDER BY file_no) AS prev FROM files),
prof AS (SELECT stream, file_no, path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM val GROUP BY 1, 2, 3),
now AS (SELECT o.stream, o.file_no, p.path, p.kinds FROM ord o JOIN prof p ON p.stream = o.stream AND p.file_no = o.file_no WHERE o.prev IS NOT NULL),
old AS (SELECT o.stream, o.file_no, p.path, p.kinds FROM ord o JOIN prof p ON p.stream = o.stream AND p.file_no = o.prev),
chg AS (SELECT coalesce(n.stream, b.stream) AS stream, coalesce(n.file_no, b.file_no) AS file_no, coalesce(n.path, b.path) AS path, b.kinds AS was, n.kinds AS is_ FROM now n FULL JOIN old b ON b.stream = n.stream AND b.file_no = n.file_no AND b.path = n.path),
gone AS (SELECT c.stream, c.file_no, c.path, v.subject_key, min(v.kind || v.value) AS lo, max(v.kind || v.value) AS hi FROM chg c JOIN ord o ON o.stream = c.stream AND o.file_no = c.file_no JOIN val v ON v.stream = c.stream AND v.file_no = o.prev AND v.path = c.path WHERE c.is_ IS NULL AND v.subject_key IS NOT NULL GROUP BY ALL),
come AS (SELECT c.stream, c.file_no, c.path, v.subject_key, min(v.kind || v.value) AS lo, max(v.kind || v.value) AS hi FROM chg c JOIN val v ON v.stream = c.stream AND v.file_no = c.file_no AND v.path = c.path WHERE c.was IS NULL AND v.subject_key IS NOT NULL GROUP BY ALL),
ren AS (SELECT g.stream, g.file_no, g.path AS old_path, c.path AS new_path FROM gone g JOIN come c ON c.stream = g.stream AND c.file_no = g.file_no AND c.subject_key = g.subject_key GROUP BY ALL HAVING bool_and(g.lo = g.hi AND c.lo = c.hi AND g.lo = c.lo))
SELECT stream, file_no, CASE WHEN was IS NULL THEN 'added' WHEN is_ IS NULL THEN 'removed' ELSE 'type_changed' END AS change_kind, path AS field_path, CASE WHEN was IS NOT NULL AND is_ IS NOT NULL THEN was || '->' || is_ ELSE '' END AS detail
FROM chg c WHERE was IS DISTINCT FROM is_ AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.stream = c.stream AND r.file_no = c.file_no AND ((c.is_ IS NULL AND r.old_path = c.path) OR (c.was IS NULL AND r.new_path = c.path)))
UNION ALL SELECT stream, file_no, 'renamed', old_path, new_path FROM ren"""

SQL = {
    "p1_found": _p1_sql() + "SELECT * FROM found",
    "p1_composite": f"""WITH decl AS (
  SELECT {_sql_clean('id')} AS record_id, {_sql_clean('crate_id')} AS crate_id, {_sql_clean('lexical_owner_id')} AS owner, coalesce(recorded_at, {_NEVER}) AS seen_at, deleted_at FROM framework_declarations WHERE {_sql_clean('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_sql_clean('id')} ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
ent AS (SELECT {_sql_clean('crate_id')} AS crate_id, {_sql_clean('id')} AS owner, coalesce(recorded_at, {_NEVER}) AS seen_at, deleted_at FROM semantic_entities),
one AS (SELECT crate_id, owner, min(seen_at) AS first_seen, coalesce(max(CASE WHEN deleted_at IS NOT NULL THEN seen_at END) = max(seen_at), false) AS gone FROM ent WHERE crate_id IS NOT NULL AND owner IS NOT NULL GROUP BY 1, 2),
tgt AS (SELECT * FROM one UNION ALL SELECT crate_id, NULL, min(first_seen), bool_and(gone) FROM one GROUP BY 1 UNION ALL SELECT NULL, owner, min(first_seen), bool_and(gone) FROM one GROUP BY owner),
j AS (SELECT d.record_id, d.crate_id, d.owner, CASE WHEN t.gone IS NULL THEN 'missing' WHEN t.gone THEN 'deleted' WHEN t.first_seen > d.seen_at THEN 'late' END AS status
  FROM decl d LEFT JOIN tgt t ON t.crate_id IS NOT DISTINCT FROM d.crate_id AND t.owner IS NOT DISTINCT FROM d.owner WHERE d.deleted_at IS NULL AND (d.crate_id IS NOT NULL OR d.owner IS NOT NULL))
SELECT * FROM j WHERE status IS NOT NULL""",
    "p1_by_table_and_period": _p1_sql() + "SELECT src_table, ref_field, period, status, count(*) AS orphans, count(DISTINCT record_id) AS records FROM found GROUP BY ALL",
    "p2_found": _P2_SQL,
    "p3_found": _p3_sql(),
    "p3_paths": _p3_sql().replace("SELECT id AS node_id, root AS root_id, depth FROM tree", "SELECT id AS node_id, path AS full_path, depth, root AS root_id FROM tree").replace("SELECT s.id, '', CASE WHEN r.id IS NULL THEN -2 ELSE -1 END FROM stuck", "SELECT s.id, '', CASE WHEN r.id IS NULL THEN -2 ELSE -1 END, '' FROM stuck"),
    "p3_descendants": f"WITH RECURSIVE {_P3_TREE.strip()} SELECT a AS ancestor, id AS descendant, depth - (i - 1) AS distance FROM (SELECT id, depth, unnest(ids) AS a, generate_subscripts(ids, 1) AS i FROM tree) WHERE depth - (i - 1) > 0",
    "p3_descendant_counts": f"WITH RECURSIVE {_P3_TREE.strip()} SELECT a AS ancestor, count(*) AS descendants, max(depth - (i - 1)) AS height FROM (SELECT id, depth, unnest(ids) AS a, generate_subscripts(ids, 1) AS i FROM tree) WHERE depth - (i - 1) > 0 GROUP BY a",
    "p4_found": f"WITH {_P4_CTES.strip()} SELECT * FROM p4",
    "p4_against_plans": f"""WITH {_P4_CTES.strip()},
plans AS (SELECT plan_id, repository_identity, target_generation AS generation, changed_paths FROM refresh_plans),
claimed AS (SELECT DISTINCT plan_id, {_SQL_PATH.format('c.path')} AS source_path FROM (SELECT plan_id, unnest(changed_paths) AS c FROM plans) WHERE c.path IS NOT NULL),
found AS (SELECT p.plan_id, q.source_path FROM p4 q JOIN plans p ON p.repository_identity = q.repository_identity AND p.generation = q.generation),
n AS (SELECT coalesce(c.plan_id, f.plan_id) AS plan_id, count(CASE WHEN c.plan_id IS NOT NULL AND f.plan_id IS NOT NULL THEN 1 END) AS agreed, count(CASE WHEN f.plan_id IS NULL THEN 1 END) AS claimed_only, count(CASE WHEN c.plan_id IS NULL THEN 1 END) AS found_only
  FROM claimed c FULL JOIN found f ON f.plan_id = c.plan_id AND f.source_path = c.source_path GROUP BY 1)
SELECT p.plan_id, p.repository_identity, p.generation, coalesce(agreed, 0) AS agreed, coalesce(claimed_only, 0) AS claimed_only, coalesce(found_only, 0) AS found_only FROM plans p LEFT JOIN n ON n.plan_id = p.plan_id""",
}
