"""Queries of refresh, answers with their members, claims, overlays and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import answers, graph, ordering, refresh, resolve
from lodestrata.plans import core
from lodestrata.plans import views as V
from lodestrata.runtime import materialize
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


# ---------------------------------------------------------------- refresh


def _chunks(spark, d, which):
    return V.revision(spark, d, which).select("repository_identity", F.concat_ws("\x1f", "repository_identity", "path").alias("source_file_id"), F.col("payload_hash").alias("hash"), "blob")


@query(f"""WITH {V.CACHE} SELECT n.repository_identity || chr(31) || n.path AS source_file_id, CASE WHEN n.blob = o.blob THEN 'reused' ELSE 'recomputed' END AS analysis_action, o.payload_hash AS baseline_hash, n.payload_hash AS target_hash
FROM new_rev n JOIN old_rev o ON o.repository_identity = n.repository_identity AND o.path = n.path""")
def chunk_rematerialisation(spark, d):
    """Chunks of both revisions; a source whose blob is the same was reused."""
    old, new = _chunks(spark, d, "first"), _chunks(spark, d, "last")
    records = new.join(old.select("source_file_id", F.col("blob").alias("b")), "source_file_id", "left").select("source_file_id", F.coalesce(F.col("blob") == F.col("b"), F.lit(False)).alias("reused"))
    return refresh.chunk_rematerialisation(old, new, records)


def _documents(spark, d, which):
    """A document per module of a revision: its digest is that of its sources' payloads in the order of paths."""
    rows = V.revision(spark, d, which).where("canonical_module_path IS NOT NULL")
    g = rows.groupBy("repository_identity", "canonical_module_path").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", F.coalesce("payload_hash", F.lit("")).alias("h")))), lambda x: x["h"]), "\n")).alias("hash"))
    return g.select("repository_identity", F.concat_ws("\x1f", "repository_identity", "canonical_module_path").alias("document_id"), F.concat("canonical_module_path", F.lit(".md")).alias("path"), "hash")


_DOCS = """dold AS (SELECT repository_identity, canonical_module_path AS m, md5(string_agg(coalesce(payload_hash, ''), chr(10) ORDER BY path, coalesce(payload_hash, ''))) AS h FROM old_rev WHERE canonical_module_path IS NOT NULL GROUP BY 1, 2),
dnew AS (SELECT repository_identity, canonical_module_path AS m, md5(string_agg(coalesce(payload_hash, ''), chr(10) ORDER BY path, coalesce(payload_hash, ''))) AS h FROM new_rev WHERE canonical_module_path IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {V.CACHE}, {_DOCS} SELECT n.repository_identity || chr(31) || n.m AS document_id, n.m || '.md' AS path, o.h AS baseline_hash, n.h AS target_hash, o.h <> n.h AS content_changed FROM dnew n JOIN dold o ON o.repository_identity = n.repository_identity AND o.m = n.m")
def document_rematerialisation(spark, d):
    return refresh.document_rematerialisation(_documents(spark, d, "first"), _documents(spark, d, "last"))


@query(f"WITH {V.CACHE}, {_DOCS} SELECT n.repository_identity, count(*) AS documents, count(*) FILTER (o.h IS NULL OR o.h <> n.h) AS changed FROM dnew n LEFT JOIN dold o ON o.repository_identity = n.repository_identity AND o.m = n.m GROUP BY 1")
def changed_documents(spark, d):
    return refresh.changed_documents(_documents(spark, d, "first"), _documents(spark, d, "last"), "repository_identity")


_MODULES = """mo AS (SELECT DISTINCT repository_identity AS r, canonical_module_path AS m FROM old_rev), mn AS (SELECT DISTINCT repository_identity AS r, canonical_module_path AS m FROM new_rev),
moved AS (SELECT DISTINCT r FROM ((SELECT * FROM mo EXCEPT SELECT * FROM mn) UNION ALL (SELECT * FROM mn EXCEPT SELECT * FROM mo)))"""


@query(f"""{core._OUTCOME}, {_MODULES}
SELECT o.plan_id, p.repository_identity, CASE WHEN outcome IN ('partial_analysis', 'inventory_only') AND moved.r IS NOT NULL THEN 'full_workspace_analysis' ELSE outcome END AS outcome, outcome IN ('partial_analysis', 'inventory_only') AND moved.r IS NOT NULL AS escalated
FROM o JOIN refresh_plans p USING (plan_id) LEFT JOIN moved ON moved.r = p.repository_identity""")
def refresh_escalated(spark, d):
    """Refresh rules, raised where a repository's modules changed."""
    plans = table(spark, d, "refresh_plans").select("plan_id", "repository_identity")
    rules = core.refresh_rule(spark, d).join(plans, "plan_id")
    modules = lambda w: V.revision(spark, d, w).select("repository_identity", F.col("canonical_module_path").alias("module"))
    return refresh.escalate(rules, modules("first"), modules("last"), "repository_identity")


#: The families of identities of a revision: what names one, and what its value is made of.
FAMILIES = {"sources": "path", "crates": "crate_id", "modules": "canonical_module_path", "source_files": "source_file_id", "extractors": "language_extractor", "mappers": "workspace_mapper", "ontologies": "ontology"}


def _family_sql(rev: str, c: str) -> str:
    return f"(SELECT repository_identity || chr(31) || {c} AS id, max(coalesce(payload_hash, '')) || '|' || count(*) AS value FROM {rev} WHERE {c} IS NOT NULL GROUP BY repository_identity, {c})"


@query(f"WITH {V.CACHE} " + " UNION ALL ".join(
    f"SELECT '{n}' AS family, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL) AS retained, count(*) FILTER (o.id IS NULL) AS added, count(*) FILTER (n.id IS NULL) AS removed, count(*) FILTER (o.id IS NOT NULL AND (n.id IS NULL OR o.value <> n.value)) AS invalidated FROM {_family_sql('old_rev', c)} o FULL JOIN {_family_sql('new_rev', c)} n ON n.id = o.id"
    for n, c in FAMILIES.items()
))
def invalidation_report(spark, d):
    """Identities of seven families that stay, come, go or have other contents."""
    old, new = (materialize(V.revision(spark, d, w), "revision") for w in ("first", "last"))

    def family(rev, c):
        g = rev.where(F.col(c).isNotNull()).groupBy("repository_identity", F.col(c).alias("__c")).agg(F.concat(F.max(F.coalesce("payload_hash", F.lit(""))), F.lit("|"), F.count(F.lit(1)).cast("string")).alias("value"))
        return g.select(F.concat_ws("\x1f", "repository_identity", "__c").alias("id"), "value")

    return refresh.invalidation_report({n: (family(old, c), family(new, c)) for n, c in FAMILIES.items()})


# ---------------------------------------------------------------- answers with their members

_SEED = "seed AS (SELECT DISTINCT subject_id AS id FROM diag WHERE subject_id IS NOT NULL)"
_FAM = """fam AS (SELECT id, 0 AS r, 'entity' AS f FROM ent UNION ALL SELECT id, 1, 'relationship' FROM edge UNION ALL SELECT id, 2, 'claim' FROM claim UNION ALL SELECT id, 3, 'evidence' FROM evid UNION ALL SELECT id, 4, 'diagnostic' FROM diag UNION ALL SELECT id, 5, 'coverage_gap' FROM gap),
known AS (SELECT s.id, arg_min(f, r) AS family FROM seed s JOIN fam ON fam.id = s.id GROUP BY 1)"""


def _members_sql(kinds: str, extra: str = "", more: str = "", seed: str = _SEED) -> str:
    return f"""WITH {V.CODE}, {seed}, {_FAM}, ed AS (SELECT * FROM edge WHERE {kinds}),
touch AS (SELECT source AS id, id AS rid, target AS other FROM ed WHERE source IN (SELECT id FROM known) UNION ALL SELECT target, id, source FROM ed WHERE target IN (SELECT id FROM known)),
linked AS (SELECT id, family, id AS member_id FROM known UNION SELECT id, 'relationship', rid FROM touch UNION SELECT id, 'entity', other FROM touch{extra}),
cl AS (SELECT l.id, c.id AS cid, c.evidence_ids FROM linked l JOIN claim c ON c.subject_id = l.member_id)
SELECT * FROM linked UNION SELECT id, 'claim', cid FROM cl UNION SELECT id, 'evidence', e FROM (SELECT id, unnest(evidence_ids) AS e FROM cl) UNION SELECT k.id, 'diagnostic', g.id FROM known k JOIN diag g ON g.subject_id = k.id UNION SELECT k.id, 'coverage_gap', g.id FROM known k JOIN gap g ON g.subject_id = k.id{more}"""


def _families(spark, d):
    known = materialize(V.entities(spark, d), "entities")
    edges = V.raw_edges(spark, d, known).join(known.select(F.col("id").alias("source")), "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi")
    return {"entity": known, "relationship": materialize(edges, "edges"), "claim": V.claims(spark, d), "evidence": V.evidence(spark, d), "diagnostic": V.diagnostics(spark, d), "coverage_gap": V.gaps(spark, d)}


def _seeds(spark, d):
    return V.diagnostics(spark, d).select(F.col("subject_id").alias("id")).where("id IS NOT NULL")


@query(_members_sql("true"))
def record_members(spark, d):
    """The whole answer to every diagnosed id: its record, claims, evidence, diagnostics, gaps and neighbours."""
    return answers.members(_seeds(spark, d), _families(spark, d))


@query(_members_sql("kind = 'CONTAINS'"))
def members_by_kind(spark, d):
    """The answer with neighbours along one kind of edge only."""
    return answers.members(_seeds(spark, d), _families(spark, d), ["CONTAINS"])


@query(_members_sql("kind = 'CONTAINS'", " UNION SELECT t.id, 'relationship', e.id FROM touch t JOIN edge e ON e.source = t.other AND e.kind = 'RESOLVES_TO' UNION SELECT t.id, 'entity', e.target FROM touch t JOIN edge e ON e.source = t.other AND e.kind = 'RESOLVES_TO'"))
def members_two_steps(spark, d):
    """The answer with a second step along edges that resolve."""
    return answers.members(_seeds(spark, d), _families(spark, d), ["CONTAINS"], through="RESOLVES_TO")


@query(_members_sql("true", " UNION SELECT a.id, 'entity', b.id FROM ent a JOIN ent b ON b.owner_id = a.owner_id AND b.kind = a.kind AND b.name = a.name AND b.id <> a.id WHERE a.id IN (SELECT id FROM known)"))
def members_with_alternatives(spark, d):
    """The answer with the other declarations of the same owner, kind and name, and their claims and evidence."""
    f = _families(spark, d)
    e = f["entity"].where("owner_id IS NOT NULL AND name IS NOT NULL").select("id", "kind", "name", "owner_id")
    # only seeds look for siblings, so a common name is never paired with itself
    mine = e.join(_seeds(spark, d).distinct(), "id", "left_semi")
    pairs = mine.join(e.withColumnRenamed("id", "sibling_id"), ["owner_id", "kind", "name"]).where("id <> sibling_id")
    return answers.members(_seeds(spark, d), f, siblings=pairs.select("id", "sibling_id"))


@query(_members_sql("true", more=f" UNION SELECT l.id, 'derivation', d.did FROM linked l JOIN (SELECT {V._urn('relationship', chr(39) + 'CONTAINS' + chr(39), 'e.owner_id', 'e.id')} AS rid, 'derived/' || e.id AS did FROM ent e WHERE e.owner_id IS NOT NULL) d ON d.rid = l.member_id WHERE l.family = 'relationship'"))
def members_with_derivations(spark, d):
    """The answer with the derivations of the relationships it holds."""
    rows = V.entities(spark, d).where("owner_id IS NOT NULL").select(F.col("owner_id").alias("parent"), F.col("id").alias("child"), F.lit(None).cast("string").alias("parent_claim"), F.lit(None).cast("string").alias("child_claim"))
    derived = graph.containment(rows, "rule.contains/v1", S.stable_id("relationship", F.lit("CONTAINS"), "parent", "child"))
    return answers.members(_seeds(spark, d), _families(spark, d), derivations=derived.select(F.col("id").alias("relationship_id"), F.concat(F.lit("derived/"), "target").alias("derivation_id")))


@query(_members_sql("true", seed="seed AS (SELECT id FROM gap UNION SELECT unnest(evidence_ids) FROM claim UNION SELECT id FROM rawe)"))
def members_of_any_family(spark, d):
    """The answers to ids of gaps, evidence and relationships: each in the first family that holds it."""
    ids = V.gaps(spark, d).select("id").unionByName(V.claims(spark, d).select(F.explode("evidence_ids").alias("id"))).unionByName(V.raw_edges(spark, d).select("id"))
    return answers.members(ids, _families(spark, d))


@query(f"WITH {V.CODE}, n AS (SELECT subject_id AS id, count(DISTINCT id) AS n, min(id) AS c FROM claim GROUP BY 1) SELECT e.id, CASE WHEN n = 1 THEN c END AS claim_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'claimed' ELSE 'ambiguous' END AS state FROM ent e LEFT JOIN n USING (id)")
def subject_claims(spark, d):
    return resolve.sole_claim(V.entities(spark, d), V.claims(spark, d))


@query(f"WITH {V.CODE}, x AS (SELECT source AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge), s AS (SELECT id, sum(o) AS o, sum(i) AS i FROM x GROUP BY 1) SELECT e.id, kind, name, lower(name) AS search, CAST(coalesce(o, 0) AS BIGINT) AS out_edges, CAST(coalesce(i, 0) AS BIGINT) AS in_edges FROM ent e LEFT JOIN s USING (id)")
def explorer_index(spark, d):
    return answers.explorer_index(V.entities(spark, d), V.edges(spark, d))


@query(f"""WITH {V.CODE}, h AS (SELECT repository_identity AS r, max(generation) AS g FROM (SELECT key.repository_identity AS repository_identity, generation FROM cache_entries) WHERE repository_identity IS NOT NULL GROUP BY 1)
SELECT p.plan_id AS document_id, CASE WHEN h.g IS NULL THEN 'unbound' WHEN p.target_generation IS NOT DISTINCT FROM h.g THEN 'current' ELSE 'stale' END AS state FROM refresh_plans p LEFT JOIN h ON h.r = p.repository_identity""")
def stale_documents(spark, d):
    """What was made for a plan's target, against the last snapshot of its repository."""
    heads = table(spark, d, "cache_entries").select(F.col("key.repository_identity").alias("repository"), "generation").where("repository IS NOT NULL").groupBy("repository").agg(F.max("generation").alias("snapshot_id"))
    docs = table(spark, d, "refresh_plans").select(F.col("plan_id").alias("document_id"), F.col("repository_identity").alias("repository"), F.col("target_generation").alias("snapshot_id"))
    return answers.stale_documents(docs, heads)


@query(f"""WITH {V.CODE}, b AS (SELECT crate_id, list_sort(list(DISTINCT role)) AS roles, list_sort(list(DISTINCT epistemic_state) FILTER (epistemic_state IS NOT NULL)) AS states FROM decl WHERE crate_id IS NOT NULL GROUP BY 1),
o AS (SELECT crate_id, list_sort(list(DISTINCT kind)) AS roles FROM ent0 WHERE crate_id IS NOT NULL GROUP BY 1)
SELECT crate_id, array_to_string(list_sort(list_distinct(list_concat(b.roles, coalesce(o.roles, [])))), ',') AS roles, array_to_string(b.states, ',') AS states FROM b LEFT JOIN o USING (crate_id)""")
def overlay_union(spark, d):
    """A crate's roles with the kinds that an overlay adds to them."""
    base = V.declarations(spark, d).where("crate_id IS NOT NULL").groupBy("crate_id").agg(F.collect_set("role").alias("roles"), F.collect_set("epistemic_state").alias("states"))
    over = V.entities(spark, d).where("crate_id IS NOT NULL AND kind NOT LIKE 'framework.%'").groupBy("crate_id").agg(F.collect_set("kind").alias("roles"))
    out = resolve.overlay_union(base, over.withColumn("states", F.array().cast("array<string>")), "crate_id", ["roles", "states"])
    return out.select("crate_id", F.array_join("roles", ",").alias("roles"), F.array_join("states", ",").alias("states"))


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS dense FROM lineitem GROUP BY 1")
def dense_ordinals(spark, d):
    return ordering.dense_groups(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 1)


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation")
def two_key_order(spark, d):
    return ordering.global_ordinal(table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), ["n_regionkey", "n_name"], "place").select("n_nationkey", "place")


@query(f"WITH {V.CODE} SELECT kind, coalesce(visibility, '') AS visibility, grouping(kind) AS all_kinds, grouping(visibility) AS all_visibilities, count(*) AS n FROM ent GROUP BY ROLLUP (kind, visibility)")
def kind_subtotals(spark, d):
    """An extra: kinds and visibilities with their subtotals and the total."""
    g = V.entities(spark, d).rollup("kind", "visibility").agg(F.grouping("kind").cast("long").alias("all_kinds"), F.grouping("visibility").cast("long").alias("all_visibilities"), F.count(F.lit(1)).alias("n"))
    return g.select("kind", F.coalesce("visibility", F.lit("")).alias("visibility"), "all_kinds", "all_visibilities", "n")


@query(f"""WITH {V.CODE}, m AS (SELECT coalesce(module_path, '') AS file, '' AS owner, kind, name, count(*) AS n FROM ent WHERE name IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT file, owner, kind, name, n AS alternatives, CASE WHEN n > 32 THEN 'too_many' ELSE 'sound' END AS state FROM m WHERE n >= 2""")
def declaration_alternatives(spark, d):
    """Declarations of one module, kind and name that stand apart: each group with its number and whether it is sound."""
    e = V.entities(spark, d).where("name IS NOT NULL").select(F.coalesce("module_path", F.lit("")).alias("file"), F.lit("").alias("owner"), "kind", "name", "id")
    # entities have no spans here: each gets one of its own, so none overlap
    at = F.abs(F.xxhash64("id"))
    return resolve.alternatives(e.withColumn("start", at).withColumn("end", at))
