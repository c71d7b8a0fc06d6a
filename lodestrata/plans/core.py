"""Queries of the graph operators over the views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import answers, federation, graph, integrity, inventory, ordering, reports, resolve, store
from lodestrata.operators.snapshots import plain_path
from lodestrata.plans import views as V
from lodestrata.plans.problems import _SQL_PATH
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


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Source files as an inventory: plain path, mode (executable where the scanner marked it), bytes."""
    t = table(spark, d, "source_files")
    mode = F.when(F.coalesce("unsupported_construct", F.lit(False)), "100755").otherwise("100644")
    return t.select("file_id", "repository_identity", plain_path(F.col("canonical_source_path")).alias("path"), F.lower(F.btrim("source_blob_oid")).alias("blob_oid"), mode.alias("mode"), F.encode("source_text", "UTF-8").alias("bytes"), "source_text")


_FILES = f"files AS (SELECT file_id, repository_identity, {_SQL_PATH.format('canonical_source_path')} AS path, lower(trim(source_blob_oid)) AS blob_oid, source_text FROM source_files)"

# ---------------------------------------------------------------- projections, predicates, scalars


@query(f"""WITH {_FILES}, b AS (SELECT *, list_extract(string_split(path, '/'), -1) AS base FROM files)
SELECT file_id, path, CASE WHEN path LIKE '%.rs' OR path LIKE '%.sh' THEN 'source' WHEN base = 'Cargo.toml' THEN 'manifest' WHEN base = 'rustfmt.toml' THEN 'configuration' WHEN base = 'README.md' THEN 'documentation' ELSE 'unsupported' END AS roles,
  CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.sh' THEN 'shell' ELSE '' END AS languages,
  CASE WHEN (path LIKE '%.rs' OR path LIKE '%.sh' OR base IN ('Cargo.toml', 'rustfmt.toml', 'README.md')) AND source_text IS NOT NULL THEN 'text_utf8' ELSE 'binary_or_unknown' END AS content_kind,
  NOT (path LIKE '%.rs' OR path LIKE '%.sh' OR base IN ('Cargo.toml', 'rustfmt.toml', 'README.md')) AS unsupported FROM b""")
def inventory_classify(spark, d):
    rows = inventory.classify(_files(spark, d))
    return rows.select("file_id", "path", F.array_join("roles", ",").alias("roles"), F.array_join("languages", ",").alias("languages"), "content_kind", "unsupported")


@query(f"WITH {V.CODE} SELECT id, 'evidence-' || lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 9, '0') AS evidence_no FROM evid")
def ordinal_evidence_ids(spark, d):
    rows = ordering.global_ordinal(V.evidence(spark, d).select("id"), ["id"])
    return rows.select("id", F.concat(F.lit("evidence-"), F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("evidence_no"))


@query("""WITH t AS (SELECT doc_id, source, lang, kind FROM documents)
SELECT doc_id, 'urn:lodestrata:document:sha256:' || sha256('["' || source || '","' || kind || '","' || doc_id || '"]') AS document_id FROM t WHERE source IS NOT NULL AND kind IS NOT NULL""")
def stable_ids(spark, d):
    t = table(spark, d, "documents").where("source IS NOT NULL AND kind IS NOT NULL")
    return t.select("doc_id", S.stable_id("document", "source", "kind", "doc_id").alias("document_id"))


@query(f"""WITH {V.CODE}, s AS (SELECT id, trim(regexp_replace(regexp_replace(lower(module_path), '^workspace_', ''), '[_:\\-]+', '-', 'g'), '-') AS slug FROM ent WHERE module_path IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(slug, '^[a-z0-9-]+$') THEN slug END AS slug FROM s""")
def module_slug(spark, d):
    return V.entities(spark, d).where("module_path IS NOT NULL").select("id", S.module_slug("module_path").alias("slug"))


@query(f"""WITH {V.CODE}, s AS (SELECT id, crate_id, trim(regexp_replace(regexp_replace(lower(module_path), '^workspace_', ''), '[_:\\-]+', '-', 'g'), '-') AS slug FROM ent WHERE module_path IS NOT NULL),
m AS (SELECT DISTINCT crate_id, slug FROM s WHERE regexp_matches(slug, '^[a-z0-9-]+$') AND crate_id IS NOT NULL)
SELECT crate_id, slug, CASE WHEN count(*) OVER (PARTITION BY slug) = 1 THEN slug ELSE slug || '-' || substr(sha256(crate_id), 1, 8) END AS document FROM m""")
def slug_frequency(spark, d):
    m = V.entities(spark, d).select("crate_id", S.module_slug("module_path").alias("slug")).where("slug IS NOT NULL AND crate_id IS NOT NULL").distinct()
    n = m.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "slug").select("crate_id", "slug", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring(F.sha2("crate_id", 256), 1, 8))).alias("document"))


@query("""SELECT doc_id, CASE WHEN u LIKE './%' OR u LIKE '../%' THEN 'relative' WHEN u LIKE '/%' THEN 'absolute_path' WHEN u LIKE 'file:%' THEN 'file' WHEN u LIKE 'ssh:%' THEN 'ssh' WHEN u LIKE 'https:%' THEN 'https' WHEN u LIKE 'http:%' THEN 'http' WHEN u LIKE 'git:%' THEN 'git'
  WHEN regexp_matches(u, '^[^/@:\\s]+@[^/:\\s]+:.+$') THEN 'scp_like' WHEN u IS NOT NULL THEN 'other' END AS url_kind
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'https://host/' || source WHEN 'de' THEN 'git@host:' || source WHEN 'fr' THEN '../' || source WHEN 'es' THEN 'ssh://host/' || source ELSE source END AS u FROM documents)""")
def url_kind(spark, d):
    u = F.when(F.col("lang") == "en", F.concat(F.lit("https://host/"), "source")).when(F.col("lang") == "de", F.concat(F.lit("git@host:"), "source")).when(F.col("lang") == "fr", F.concat(F.lit("../"), "source")).when(F.col("lang") == "es", F.concat(F.lit("ssh://host/"), "source")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", S.url_kind(u).alias("url_kind"))


_CHECKED = """CASE WHEN v BETWEEN -128 AND 127 THEN CAST(v AS BIGINT) END"""


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS HUGEINT) AS a, CAST(l_linenumber AS HUGEINT) AS b FROM lineitem), r AS (
  SELECT l_orderkey, l_linenumber, o, CASE o WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '/' THEN a // b WHEN '%' THEN a % b END AS v FROM t, (VALUES ('+'), ('-'), ('*'), ('/'), ('%')) AS ops(o))
SELECT l_orderkey, l_linenumber, o AS operator, {_CHECKED} AS result FROM r""")
def checked_arith(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(38,0)").alias("a"), F.col("l_linenumber").cast("decimal(38,0)").alias("b"))
    each = [F.struct(F.lit(o).alias("operator"), S.checked(o, F.col("a"), F.col("b"), F.lit("i8")).cast("long").alias("result")) for o in "+-*/%"]
    return t.select("l_orderkey", "l_linenumber", F.explode(F.array(*each)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query(f"""WITH {V.CODE}, p AS (SELECT id, epistemic_state AS old_state, 'superseded' AS new_state FROM decl UNION ALL SELECT id, CASE WHEN target_binding = 'resolved_unique' THEN 'candidate' ELSE 'rejected' END, 'confirmed' FROM decl)
SELECT old_state, new_state, (old_state || '>' || new_state) IN ({', '.join(f"'{a}>{b}'" for a, b in S.TRANSITIONS)}) AS legal, count(*) AS n FROM p GROUP BY ALL""")
def claim_transition(spark, d):
    f = V.declarations(spark, d)
    p = f.select(F.col("epistemic_state").alias("old_state"), F.lit("superseded").alias("new_state")).unionByName(f.select(F.when(F.col("target_binding") == "resolved_unique", "candidate").otherwise("rejected").alias("old_state"), F.lit("confirmed").alias("new_state")))
    return p.groupBy("old_state", "new_state", S.is_transition(F.col("old_state"), F.col("new_state")).alias("legal")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FILES}, t AS (SELECT file_id, source_text AS s, CAST(strlen(source_text) // 2 AS BIGINT) AS o FROM files WHERE source_text IS NOT NULL)
SELECT file_id, o AS byte_offset, CAST(length(left(s, o)) - length(replace(left(s, o), chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(list_extract(string_split(left(s, o), chr(10)), -1)) + 1 AS BIGINT) AS col FROM t""")
def byte_to_line_col(spark, d):
    t = _files(spark, d).where("source_text IS NOT NULL").withColumn("o", F.floor(F.octet_length("bytes") / 2).cast("long"))
    return t.select("file_id", F.col("o").alias("byte_offset"), S.line_column(F.col("bytes"), F.col("o")).alias("p")).select("file_id", "byte_offset", F.col("p.line").alias("line"), F.col("p.column").alias("col"))


# ---------------------------------------------------------------- exact lookup and neighbourhoods


def _families(spark, d):
    return {"entity": V.entities(spark, d), "relationship": V.raw_edges(spark, d), "claim": V.claims(spark, d), "evidence": V.evidence(spark, d), "diagnostic": V.diagnostics(spark, d), "coverage_gap": V.gaps(spark, d)}


@query(f"""WITH {V.CODE}, ids AS (SELECT subject_id AS id FROM diag UNION SELECT subject_id FROM gap UNION SELECT unnest(evidence_ids) FROM claim UNION SELECT local_target_id FROM decl),
fam AS (SELECT id, 0 AS r, 'entity' AS f FROM ent UNION ALL SELECT id, 1, 'relationship' FROM rawe UNION ALL SELECT id, 2, 'claim' FROM claim UNION ALL SELECT id, 3, 'evidence' FROM evid UNION ALL SELECT id, 4, 'diagnostic' FROM diag UNION ALL SELECT id, 5, 'coverage_gap' FROM gap)
SELECT i.id, (SELECT f FROM fam WHERE fam.id = i.id ORDER BY r LIMIT 1) AS family FROM ids i WHERE i.id IS NOT NULL""")
def exact_id_lookup(spark, d):
    ids = V.diagnostics(spark, d).select(F.col("subject_id").alias("id")).unionByName(V.gaps(spark, d).select(F.col("subject_id").alias("id"))).unionByName(V.claims(spark, d).select(F.explode("evidence_ids").alias("id"))).unionByName(V.declarations(spark, d).select(F.col("local_target_id").alias("id")))
    return answers.lookup(ids.where("id IS NOT NULL"), _families(spark, d))


@query(f"""WITH {V.CODE}, seed AS (SELECT DISTINCT subject_id AS id FROM diag WHERE subject_id IN (SELECT id FROM ent))
SELECT source AS seed, id AS relationship_id, kind, 'out' AS direction, target AS other FROM edge WHERE source IN (SELECT id FROM seed)
UNION ALL SELECT target, id, kind, 'in', source FROM edge WHERE target IN (SELECT id FROM seed)""")
def neighbourhood_1hop(spark, d):
    seeds = V.diagnostics(spark, d).select(F.col("subject_id").alias("id")).where("id IS NOT NULL").distinct()
    return graph.incident(V.edges(spark, d), seeds)


@query(f"WITH {V.CODE} SELECT DISTINCT a.source AS seed, a.target AS via, b.target AS reached FROM edge a JOIN edge b ON b.source = a.target AND b.kind = 'RESOLVES_TO' WHERE a.kind = 'CONTAINS'")
def two_step_neighbourhood(spark, d):
    e = V.edges(spark, d)
    return graph.two_step(e, e.select(F.col("source").alias("id")).distinct(), "CONTAINS", "RESOLVES_TO")


@query(f"""WITH {V.TRADE}, e AS (SELECT * FROM trade WHERE kind = 'CONTAINS'), flat AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), seed AS (SELECT DISTINCT source AS s FROM e WHERE source LIKE 'nation/%'),
h1 AS (SELECT DISTINCT s, b AS id FROM seed JOIN flat ON a = s WHERE b <> s), r1 AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY id) AS p FROM h1), k1 AS (SELECT s, id FROM r1 WHERE 1 + p <= 256),
n1 AS (SELECT s, count(*) + 1 AS have FROM k1 GROUP BY s),
h2 AS (SELECT DISTINCT k.s, f.b AS id FROM k1 k JOIN flat f ON f.a = k.id WHERE f.b <> k.s AND NOT EXISTS (SELECT 1 FROM k1 x WHERE x.s = k.s AND x.id = f.b)),
r2 AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY id) AS p FROM h2), k2 AS (SELECT r2.s, id FROM r2 JOIN n1 USING (s) WHERE have + p <= 256),
cut AS (SELECT DISTINCT s FROM r1 WHERE 1 + p > 256 UNION SELECT r2.s FROM r2 JOIN n1 USING (s) WHERE have + p > 256)
SELECT x.s AS seed, x.id, x.hops, x.s IN (SELECT s FROM cut) AS truncated FROM (SELECT s, s AS id, 0 AS hops FROM seed UNION ALL SELECT s, id, 1 FROM k1 UNION ALL SELECT s, id, 2 FROM k2) x""")
def bounded_bfs(spark, d):
    e = V.trade_edges(spark, d).where("kind = 'CONTAINS'")
    return graph.bounded_traversal(e, e.where("source LIKE 'nation/%'").select(F.col("source").alias("id")).distinct(), 2, 256)


@query(f"WITH {V.CODE} SELECT c.id AS claim_id, c.subject_id, c.state, e.id AS evidence_id, e.path FROM (SELECT id, subject_id, state, unnest(evidence_ids) AS x FROM claim) c LEFT JOIN evid e ON e.id = c.x")
def claim_evidence_join(spark, d):
    c = V.claims(spark, d).select(F.col("id").alias("claim_id"), "subject_id", "state", F.explode("evidence_ids").alias("x"))
    e = V.evidence(spark, d).select(F.col("id").alias("evidence_id"), "path")
    return c.join(e, c["x"] == e["evidence_id"], "left").drop("x")


@query(f"""WITH {V.CODE}, st AS (SELECT c.id AS statement_id, unnest([subject_id]) AS ref FROM claim c UNION SELECT id, unnest(evidence_ids) FROM claim UNION SELECT c.id, g.id FROM claim c JOIN gap g ON g.subject_id = c.subject_id)
SELECT ref AS id, count(*) AS statements FROM st GROUP BY ref""")
def statement_reverse_lookup(spark, d):
    c = V.claims(spark, d)
    g = V.gaps(spark, d).select("subject_id", F.col("id").alias("ref"))
    refs = c.select(F.col("id").alias("s"), F.explode(F.array_append("evidence_ids", F.col("subject_id"))).alias("ref")).unionByName(c.join(g, "subject_id").select(F.col("id").alias("s"), "ref"))
    return refs.distinct().groupBy(F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("statements"))


@query(f"WITH {V.CODE} SELECT id, kind, source, target FROM rawe WHERE source NOT IN (SELECT id FROM ent) OR target NOT IN (SELECT id FROM ent)")
def dangling_edges(spark, d):
    known = materialize(V.entities(spark, d).select("id", "owner_id"), "entities")
    ids = known.select("id", F.lit(True).alias("there"))
    ends = V.raw_edges(spark, d, known).join(ids.select(F.col("id").alias("source"), F.col("there").alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("there").alias("t")), "target", "left")
    return ends.where("s IS NULL OR t IS NULL").select("id", "kind", "source", "target")


@query(f"WITH {V.CODE} SELECT id, subject_id, 'diagnostic' AS family FROM diag WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM decl) UNION ALL SELECT id, subject_id, 'coverage_gap' FROM gap WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM decl)")
def dangling_claims(spark, d):
    n = V.diagnostics(spark, d).select("id", "subject_id", F.lit("diagnostic").alias("family")).unionByName(V.gaps(spark, d).select("id", "subject_id", F.lit("coverage_gap").alias("family")))
    return n.where("subject_id IS NOT NULL").join(V.declarations(spark, d).select(F.col("id").alias("subject_id")), "subject_id", "left_anti")


@query(f"WITH {V.CODE} SELECT id, path, start_byte, end_byte FROM evid WHERE id IN (SELECT unnest(evidence_ids) FROM claim)")
def referenced_evidence(spark, d):
    used = V.claims(spark, d).select(F.explode("evidence_ids").alias("id")).distinct()
    return V.evidence(spark, d).join(used, "id", "left_semi").select("id", "path", "start_byte", "end_byte")


@query(f"WITH {V.CODE} SELECT subject_id, id, capability FROM gap g WHERE EXISTS (SELECT 1 FROM diag x WHERE x.subject_id = g.subject_id)")
def uncertainty_selection(spark, d):
    return V.gaps(spark, d).join(V.diagnostics(spark, d).select("subject_id"), "subject_id", "left_semi").select("subject_id", "id", "capability")


# ---------------------------------------------------------------- aggregation, windows, sorting


@query(f"WITH {V.CODE} SELECT 'entity' AS family, kind, count(*) AS n FROM ent GROUP BY kind UNION ALL SELECT 'relationship', kind, count(*) FROM edge GROUP BY kind")
def kind_counts(spark, d):
    count = lambda df, f: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("family"), "kind", "n")
    return count(V.entities(spark, d), "entity").unionByName(count(V.edges(spark, d), "relationship"))


@query(f"WITH {V.CODE} SELECT repository_identity, count(*) FILTER (role = 'route') AS route, count(*) FILTER (role = 'handler') AS handler, count(*) FILTER (role = 'service') AS service, count(*) FILTER (role = 'component') AS component, count(*) AS total FROM decl GROUP BY 1")
def role_pivot(spark, d):
    roles = ["route", "handler", "service", "component"]
    return V.declarations(spark, d).groupBy("repository_identity").agg(*[F.count(F.when(F.col("role") == r, 1)).alias(r) for r in roles], F.count(F.lit(1)).alias("total"))


@query(f"""WITH {V.CODE}, n AS (SELECT *, count(*) OVER (PARTITION BY kind, name) AS alternatives FROM ent WHERE name IS NOT NULL) SELECT id, kind, name, alternatives FROM n WHERE alternatives >= 2""")
def alternatives_having2(spark, d):
    """Members of groups of two or more of one kind and name: a row each, so that no group is gathered whole."""
    e = V.entities(spark, d).where("name IS NOT NULL").select("id", "kind", "name")
    n = e.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("alternatives")).where("alternatives >= 2")
    return e.join(n, ["kind", "name"]).select("id", "kind", "name", "alternatives")


@query(f"""WITH {V.CODE}, u AS (SELECT DISTINCT repository_identity, role, unnest(evidence_ids) AS e FROM decl), p AS (SELECT repository_identity, role, substr(sha256(e), 1, 6) AS part, sha256(string_agg('["' || e || '"]', chr(10) ORDER BY e)) AS h, count(*) AS n FROM u GROUP BY 1, 2, 3),
q AS (SELECT repository_identity, role, substr(part, 1, 3) AS up, sha256(string_agg(h, chr(10) ORDER BY part)) AS uh, sum(n) AS n FROM p GROUP BY 1, 2, 3)
SELECT repository_identity, role, sha256(string_agg(uh, chr(10) ORDER BY up)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM q GROUP BY 1, 2""")
def evidence_union(spark, d):
    """The distinct evidence of a repository's roles: its size and a two-level digest of the sorted ids."""
    x = V.declarations(spark, d).select("repository_identity", "role", F.explode("evidence_ids").alias("e")).distinct()
    return integrity.generation_hash(x, ["repository_identity", "role"], "e", [])


@query(f"""WITH {V.CACHE}, r AS (SELECT *, 'first' AS at_rev FROM old_rev UNION ALL SELECT *, 'last' FROM new_rev),
e AS (SELECT repository_identity, at_rev, substr(sha256(path), 1, 6) AS part, CAST(to_json([path, coalesce(blob, ''), coalesce(payload_hash, '')]) AS VARCHAR) AS entry FROM r),
p AS (SELECT repository_identity, at_rev, part, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h, count(*) AS n FROM e GROUP BY 1, 2, 3),
q AS (SELECT repository_identity, at_rev, substr(part, 1, 3) AS up, sha256(string_agg(h, chr(10) ORDER BY part)) AS uh, sum(n) AS n FROM p GROUP BY 1, 2, 3)
SELECT repository_identity, at_rev AS at, sha256(string_agg(uh, chr(10) ORDER BY up)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM q GROUP BY 1, 2""")
def generation_hash(spark, d):
    """Digest of every repository's first and last snapshot; equal contents give equal digests."""
    rows = V.revision(spark, d, "first").withColumn("at", F.lit("first")).unionByName(V.revision(spark, d, "last").withColumn("at", F.lit("last")))
    return integrity.generation_hash(rows, ["repository_identity", "at"], "path", ["blob", "payload_hash"])


@query(f"""WITH {V.TRADE}, x AS (SELECT source AS id, 'out_' || lower(kind) AS k FROM trade UNION ALL SELECT target, 'in_' || lower(kind) FROM trade)
SELECT id, count(*) FILTER (k = 'in_contains') AS in_contains, count(*) FILTER (k = 'out_contains') AS out_contains, count(*) FILTER (k = 'in_defines') AS in_defines, count(*) FILTER (k = 'out_defines') AS out_defines, count(*) FILTER (k = 'in_references') AS in_references, count(*) FILTER (k = 'out_references') AS out_references FROM x GROUP BY id""")
def degree_pivot(spark, d):
    return graph.degrees(V.trade_edges(spark, d), ["CONTAINS", "DEFINES", "REFERENCES"])


@query("SELECT o_orderpriority, p AS percent, list_extract(list_sort(v), greatest(CAST(ceil(p * len(v) / 100.0) AS BIGINT), 1)) AS o_totalprice FROM (SELECT o_orderpriority, list(o_totalprice) AS v FROM orders GROUP BY 1), (VALUES (50), (95), (99)) AS t(p)")
def nearest_rank_percentile(spark, d):
    return ordering.nearest_rank(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", [50, 95, 99])


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_ordinals(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count_distinct("l_linenumber").alias("u"))
    return g.select("l_orderkey", "n", ((F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("u") == F.col("n"))).alias("contiguous"))


#: A total order of an order's lines, whose numbers may repeat.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag"]
_LINE_SQL = ", ".join(_LINE)


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SQL}) AS p FROM lineitem) WHERE p >= l_shipdate")
def strict_order_check(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    return table(spark, d, "lineitem").withColumn("p", F.lag("l_shipdate").over(w)).where("p >= l_shipdate").select("l_orderkey", "l_linenumber")


_EXPLICIT = "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SQL}) AS rn, {_EXPLICIT} AS x FROM lineitem), g AS (SELECT *, count(x) OVER (PARTITION BY l_orderkey ORDER BY rn) AS run FROM t)
SELECT l_orderkey, l_linenumber, coalesce(max(x) OVER (PARTITION BY l_orderkey, run), 0) + row_number() OVER (PARTITION BY l_orderkey, run ORDER BY rn) - 1 AS discriminant FROM g""")
def implicit_discriminant(spark, d):
    """A variant's value is its own, else the one before plus one, from 0: the last explicit value and the steps since."""
    place = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_EXPLICIT).alias("x"), F.row_number().over(place).alias("at"))
    given = F.last(F.when(F.col("x").isNotNull(), F.struct("x", "at")), True).over(Window.partitionBy("l_orderkey").orderBy("at"))
    return t.withColumn("g", given).select("l_orderkey", "l_linenumber", F.when(F.col("g").isNull(), F.col("at") - 1).otherwise(F.col("g.x") + F.col("at") - F.col("g.at")).cast("long").alias("discriminant"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS reverse_ordinal FROM lineitem")
def reverse_ordinal(spark, d):
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("l_linenumber"))).alias("reverse_ordinal"))


@query(f"WITH {V.CODE} SELECT id, kind, name FROM ent WHERE contains(lower(name), 'cache') ORDER BY name, id LIMIT 100")
def top100_search(spark, d):
    """The hundred first entities by name that hold a word: a viewer's search, its limit is the feature."""
    return V.entities(spark, d).where(F.contains(F.lower("name"), F.lit("cache"))).select("id", "kind", "name").orderBy("name", "id").limit(100)


_SPANS = "s AS (SELECT id, path, start_byte AS a, end_byte AS b FROM evid WHERE path IS NOT NULL AND start_byte <= end_byte)"


@query(f"WITH {V.CODE}, {_SPANS} SELECT i.id, count(*) AS depth FROM s i JOIN s o ON o.path = i.path AND o.id <> i.id AND o.a <= i.a AND i.b <= o.b AND (o.b - o.a) > (i.b - i.a) GROUP BY i.id")
def lexical_depth(spark, d):
    s = _spans(spark, d)
    pairs = resolve.containing(s, s, ["path"]).join(s.select(F.col("id").alias("inner_id"), (F.col("end") - F.col("start")).alias("w")), "inner_id")
    return pairs.where("inner_id <> outer_id AND width > w").groupBy(F.col("inner_id").alias("id")).agg(F.count(F.lit(1)).alias("depth"))


def _spans(spark, d):
    return V.evidence(spark, d).where("path IS NOT NULL").select("id", "path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))


# ---------------------------------------------------------------- resolution joins


@query(f"""WITH {V.CODE}, {_SPANS}, p AS (SELECT i.id AS inner_id, o.id AS outer_id FROM s i JOIN s o ON o.path = i.path AND o.id <> i.id AND o.a <= i.a AND i.b <= o.b)
SELECT inner_id, CASE WHEN count(*) = 1 THEN min(outer_id) END AS owner_id, count(*) AS owners FROM p GROUP BY 1""")
def range_owner_join(spark, d):
    s = _spans(spark, d)
    return resolve.sole_owner(resolve.containing(s, s, ["path"]).where("inner_id <> outer_id"))


@query(f"""WITH {V.CODE}, {_SPANS}, p AS (SELECT i.id AS inner_id, o.id AS outer_id, o.b - o.a AS w, o.a AS oa FROM s i JOIN s o ON o.path = i.path AND o.id <> i.id AND o.a <= i.a AND i.b <= o.b),
r AS (SELECT *, rank() OVER (PARTITION BY inner_id ORDER BY w, oa DESC) AS k FROM p)
SELECT inner_id, CASE WHEN count(*) = 1 THEN min(outer_id) END AS outer_id, count(*) > 1 AS shadowed FROM r WHERE k = 1 GROUP BY inner_id""")
def narrowest_scope(spark, d):
    s = _spans(spark, d)
    return resolve.narrowest(resolve.containing(s, s, ["path"]).where("inner_id <> outer_id"))


_NAMES = "nm AS (SELECT id, crate_id AS crate, module_path AS module, name FROM ent0 WHERE name IS NOT NULL AND crate_id IS NOT NULL)"


@query(f"""WITH {V.CODE}, {_NAMES}, call AS (SELECT id AS call_id, crate_id AS crate, CASE WHEN contains(target_spelling, '::') THEN list_extract(string_split(target_spelling, '::'), 1) END AS module, list_extract(string_split(target_spelling, '::'), -1) AS name, contains(target_spelling, '::') AS qualified FROM decl WHERE target_spelling IS NOT NULL),
ex AS (SELECT crate, module, name, min(id) AS t FROM nm GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1), cr AS (SELECT crate, name, min(id) AS t FROM nm GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT c.call_id, coalesce(ex.t, CASE WHEN NOT qualified THEN cr.t END) AS target, CASE WHEN ex.t IS NOT NULL THEN 'exact' WHEN NOT qualified AND cr.t IS NOT NULL THEN 'crate' ELSE 'unresolved' END AS tier
FROM call c LEFT JOIN ex ON ex.crate = c.crate AND ex.module = c.module AND ex.name = c.name LEFT JOIN cr ON cr.crate = c.crate AND cr.name = c.name""")
def two_tier_resolve(spark, d):
    t = F.col("target_spelling")
    q = t.contains("::")
    calls = V.declarations(spark, d).where("target_spelling IS NOT NULL").select(F.col("id").alias("call_id"), F.col("crate_id").alias("crate"), F.when(q, F.split(t, "::")[0]).alias("module"), F.element_at(F.split(t, "::"), -1).alias("name"), q.alias("qualified"))
    names = V.entities(spark, d).where("name IS NOT NULL AND crate_id IS NOT NULL AND kind NOT LIKE 'framework.%'").select("id", F.col("crate_id").alias("crate"), F.col("module_path").alias("module"), "name")
    return resolve.two_tier(calls, names)


@query(f"""WITH {V.CODE}, nm AS (SELECT name AS path, kind, id FROM ent0 WHERE name IS NOT NULL), h AS (SELECT path, count(DISTINCT kind) AS kinds, min(id) AS hit FROM nm GROUP BY 1)
SELECT d.id AS import_id, CASE WHEN kinds = 1 THEN hit END AS target, CASE WHEN kinds = 1 THEN 'resolved' ELSE 'unresolved' END AS resolution, coalesce(kinds, 0) AS kinds FROM decl d LEFT JOIN h ON h.path = d.declared_key_or_target""")
def import_resolve(spark, d):
    imports = V.declarations(spark, d).select(F.col("id").alias("import_id"), F.col("declared_key_or_target").alias("path"))
    names = V.entities(spark, d).where("name IS NOT NULL AND kind NOT LIKE 'framework.%'").select(F.col("name").alias("path"), "kind", "id")
    return resolve.sole_kind(imports, names)


@query(f"""WITH {V.CODE}, h AS (SELECT crate_id, name, count(DISTINCT id) AS n, min(id) AS t FROM ent0 GROUP BY 1, 2)
SELECT d.id AS ref_id, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved_external' WHEN n = 1 THEN 'resolved_unique' ELSE 'ambiguous_local' END AS state, CASE WHEN n = 1 THEN t END AS target, coalesce(n, 0) AS candidates FROM decl d LEFT JOIN h ON h.crate_id = d.crate_id AND h.name = list_extract(string_split(d.target_spelling, '::'), -1)""")
def target_binding(spark, d):
    refs = V.declarations(spark, d).select(F.col("id").alias("ref_id"), "crate_id", F.element_at(F.split("target_spelling", "::"), -1).alias("name"))
    catalog = V.entities(spark, d).where("kind NOT LIKE 'framework.%'").select("id", "crate_id", "name")
    return resolve.trichotomy(refs, catalog, ["crate_id", "name"], ("unresolved_external", "resolved_unique", "ambiguous_local"))


@query(f"""WITH {_FILES}, f AS (SELECT DISTINCT path FROM files), m AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '/mod\\.rs$', ''), '\\.rs$', '') AS module FROM f WHERE path LIKE '%.rs' UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM f WHERE path LIKE '%/%')
SELECT m.module, CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'ambiguous' WHEN coalesce(a.path, b.path) IS NULL THEN 'missing' ELSE 'resolved' END AS state, CASE WHEN NOT (a.path IS NOT NULL AND b.path IS NOT NULL) THEN coalesce(a.path, b.path) END AS path FROM m LEFT JOIN f a ON a.path = m.module || '.rs' LEFT JOIN f b ON b.path = m.module || '/mod.rs'""")
def module_resolve(spark, d):
    f = _files(spark, d).select("path").distinct()
    named = f.where("path LIKE '%.rs'").select(F.regexp_replace(F.regexp_replace("path", r"/mod\.rs$", ""), r"\.rs$", "").alias("module"))
    folders = f.where("path LIKE '%/%'").select(F.regexp_replace("path", r"/[^/]*$", "").alias("module"))
    return resolve.module_file(named.unionByName(folders), f)


@query(f"""WITH {V.CODE}, a AS (SELECT name AS k, min(id) AS l FROM ent0 WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1), b AS (SELECT declared_key_or_target AS k, min(id) AS r FROM decl WHERE declared_key_or_target IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT k, l AS left_id, r AS right_id FROM a JOIN b USING (k)""")
def unique_pair_join(spark, d):
    left = V.entities(spark, d).where("kind NOT LIKE 'framework.%' AND name IS NOT NULL").select("id", F.col("name").alias("k"))
    right = V.declarations(spark, d).where("declared_key_or_target IS NOT NULL").select("id", F.col("declared_key_or_target").alias("k"))
    return resolve.unique_pairs(left, right, "k")


@query("""WITH g AS (SELECT DISTINCT key.repository_identity AS path FROM cache_entries WHERE key.repository_identity IS NOT NULL), dd AS (SELECT DISTINCT repository_identity AS path FROM refresh_plans WHERE repository_identity IS NOT NULL), n AS (SELECT DISTINCT repository_identity AS path FROM source_files WHERE language = 'kotlin' AND repository_identity IS NOT NULL)
SELECT coalesce(g.path, dd.path) AS path, CASE WHEN g.path IS NULL THEN 'orphan_declaration' WHEN n.path IS NOT NULL THEN 'explicitly_bound' WHEN dd.path IS NOT NULL THEN 'declared_unbound' ELSE 'undeclared_unbound' END AS state,
  concat_ws(',', CASE WHEN g.path IS NOT NULL AND dd.path IS NULL THEN 'boundary.gitmodules_declaration_missing' END, CASE WHEN g.path IS NULL THEN 'boundary.gitmodules_declaration_orphan' END, CASE WHEN g.path IS NOT NULL AND n.path IS NOT NULL THEN 'boundary.nested_repository_not_analyzed' END, CASE WHEN g.path IS NOT NULL AND n.path IS NULL THEN 'boundary.nested_repository_unbound' END) AS gaps
FROM g FULL JOIN dd ON dd.path = g.path LEFT JOIN n ON n.path = coalesce(g.path, dd.path)""")
def boundary_report(spark, d):
    pick = lambda t, c: table(spark, d, t).select(F.col(c).alias("path")).where("path IS NOT NULL").distinct()
    links = pick("cache_entries", "key.repository_identity").withColumn("oid", F.sha1("path"))
    nested = table(spark, d, "source_files").where("language = 'kotlin' AND repository_identity IS NOT NULL").select(F.col("repository_identity").alias("path")).distinct().withColumn("oid", F.sha1("path"))
    rows = inventory.boundary_report(links, pick("refresh_plans", "repository_identity"), nested)
    return rows.select("path", "state", F.array_join("gaps", ",").alias("gaps"))


# ---------------------------------------------------------------- revisions, cache and refresh


@query(f"""WITH {V.CACHE} SELECT coalesce(o.repository_identity, n.repository_identity) AS repository_identity, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind, o.blob AS old_blob, n.blob AS new_blob
FROM old_rev o FULL JOIN new_rev n ON n.repository_identity = o.repository_identity AND n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR o.blob IS DISTINCT FROM n.blob""")
def inventory_diff(spark, d):
    return inventory.inventory_diff(V.revision(spark, d, "first"), V.revision(spark, d, "last"), ["repository_identity", "path"], ["blob"])


@query(f"""WITH {V.CACHE}, j AS (SELECT o.path AS op, n.path AS np, coalesce(o.repository_identity, n.repository_identity) AS r, o.payload_hash AS a, n.payload_hash AS b FROM old_rev o FULL JOIN new_rev n ON n.repository_identity = o.repository_identity AND n.path = o.path)
SELECT r AS repository_identity, count(*) FILTER (op IS NOT NULL AND np IS NOT NULL) AS retained, count(*) FILTER (op IS NULL) AS added, count(*) FILTER (np IS NULL) AS removed, count(*) FILTER (op IS NOT NULL AND (np IS NULL OR a IS DISTINCT FROM b)) AS invalidated FROM j GROUP BY 1""")
def identity_delta(spark, d):
    key = F.concat_ws("\x1f", "repository_identity", "path")
    rows = inventory.identity_delta(V.revision(spark, d, "first").withColumn("k", key), V.revision(spark, d, "last").withColumn("k", key), "k", "payload_hash")
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return rows.groupBy(F.substring_index("k", "\x1f", 1).alias("repository_identity")).agg(is_("retained"), is_("added"), is_("removed"), F.count(F.when(F.col("invalidated"), 1)).alias("invalidated"))


@query(f"""WITH {V.CACHE}, k AS (SELECT DISTINCT repository_identity, path, blob FROM old_rev WHERE blob IS NOT NULL)
SELECT n.repository_identity, count(*) AS sources, count(k.path) AS reused, count(*) - count(k.path) AS parser_invocations FROM new_rev n LEFT JOIN k ON k.repository_identity = n.repository_identity AND k.path = n.path AND k.blob = n.blob GROUP BY 1""")
def cache_probe(spark, d):
    """A source is reused where the cache of the first revision has its derived entry id; a miss is a parser invocation."""
    entry = S.stable_id("analysis-cache-entry", "repository_identity", "path", "blob")
    cached = V.revision(spark, d, "first").where("blob IS NOT NULL").select(entry.alias("entry")).distinct().withColumn("hit", F.lit(1))
    rows = V.revision(spark, d, "last").withColumn("entry", entry).join(cached, "entry", "left")
    return rows.groupBy("repository_identity").agg(F.count(F.lit(1)).alias("sources"), F.count("hit").alias("reused"), F.count(F.when(F.col("hit").isNull(), 1)).alias("parser_invocations"))


_EIGHT = ["repository_identity", "path", "crate_id", "source_file_id", "canonical_module_path", "language_extractor", "workspace_mapper", "ontology"]


@query(f"WITH {V.CACHE} SELECT n.repository_identity, n.path FROM new_rev n WHERE EXISTS (SELECT 1 FROM old_rev o WHERE {' AND '.join(f'o.{c} = n.{c}' for c in _EIGHT)})")
def stable_sources(spark, d):
    return V.revision(spark, d, "last").join(V.revision(spark, d, "first").select(*_EIGHT), _EIGHT, "left_semi").select("repository_identity", "path")


_OUTCOME = f"""WITH {V.CACHE}, st AS (SELECT n.repository_identity AS r, n.path FROM new_rev n WHERE EXISTS (SELECT 1 FROM old_rev o WHERE {' AND '.join(f'o.{c} = n.{c}' for c in _EIGHT)})),
ch AS (SELECT plan_id, repository_identity AS r, {_SQL_PATH.format('c.path')} AS path, c.change_kind AS kind, c.change_kind <> 'modified' OR lower(trim(c.baseline_blob_oid)) IS DISTINCT FROM lower(trim(c.target_blob_oid)) AS content FROM (SELECT plan_id, repository_identity, unnest(changed_paths) AS c FROM refresh_plans)),
x AS (SELECT ch.*, st.path IS NOT NULL AS stable FROM ch LEFT JOIN st ON st.r = ch.r AND st.path = ch.path),
s AS (SELECT plan_id, count(*) AS n, bool_or(content AND (path = 'Cargo.toml' OR path LIKE '%/Cargo.toml' OR path LIKE '%/src/lib.rs' OR path LIKE '%/src/main.rs' OR path LIKE '%/mod.rs' OR (path LIKE '%.rs' AND (kind <> 'modified' OR NOT stable)))) AS wide, bool_or(content AND path LIKE '%.rs') AS part FROM x GROUP BY 1),
o AS (SELECT p.plan_id, CASE WHEN p.baseline_generation IS NULL THEN 'full_rebuild' WHEN p.baseline_generation = p.target_generation AND coalesce(n, 0) = 0 THEN 'no_change' WHEN coalesce(wide, false) THEN 'full_workspace_analysis' WHEN coalesce(part, false) THEN 'partial_analysis' ELSE 'inventory_only' END AS outcome FROM refresh_plans p LEFT JOIN s ON s.plan_id = p.plan_id)"""
_RULE = f"""{_OUTCOME}
SELECT plan_id, outcome, 'INC-RULE-' || CASE outcome WHEN 'full_rebuild' THEN '002' WHEN 'full_workspace_analysis' THEN '003' WHEN 'partial_analysis' THEN '004' WHEN 'inventory_only' THEN '005' ELSE '006' END AS rule_id FROM o"""


@query(_RULE)
def refresh_rule(spark, d):
    t = table(spark, d, "refresh_plans")
    plans = t.select("plan_id", F.coalesce(F.col("baseline_generation") == F.col("target_generation"), F.lit(False)).alias("same_commit"), F.col("baseline_generation").isNotNull().alias("compatible"))
    c = t.select("plan_id", "repository_identity", F.explode("changed_paths").alias("c"))
    blob = lambda s: F.lower(F.btrim(F.col(f"c.{s}_blob_oid")))
    changes = c.select("plan_id", "repository_identity", plain_path(F.col("c.path")).alias("path"), F.col("c.change_kind").alias("change_kind"), ((F.col("c.change_kind") != "modified") | ~blob("baseline").eqNullSafe(blob("target"))).alias("content_changed"))
    stable = changes.join(stable_sources(spark, d), ["repository_identity", "path"], "left_semi").select("plan_id", "path")
    return federation.refresh_rule(plans, changes.drop("repository_identity"), stable)


@query(f"""WITH {V.CACHE}, a AS (SELECT repository_identity, path, blob FROM new_rev), b AS (SELECT repository_identity, path, blob FROM old_rev)
SELECT 'only_left' AS side, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n UNION ALL SELECT 'only_right', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def cold_equivalence(spark, d):
    cols = ["repository_identity", "path", "blob"]
    return integrity.equal_tables(V.revision(spark, d, "last").select(*cols), V.revision(spark, d, "first").select(*cols))


# ---------------------------------------------------------------- federation and impact


def _operations(spark, d):
    """Operations: the methods and paths of declarations, by repository."""
    t = V.declarations(spark, d).where("path IS NOT NULL AND method IS NOT NULL")
    return t.select(S.stable_id("operation", "repository_identity", "method", "path").alias("operation_id"), F.col("repository_identity").alias("title"), F.col("path").alias("operation_name"), "method").distinct()


_OPS = f"""op AS (SELECT DISTINCT {V._urn('operation', 'repository_identity', 'method', 'path')} AS operation_id, repository_identity AS title, path AS operation_name, method FROM decl WHERE path IS NOT NULL AND method IS NOT NULL)"""
_CLIENTS = f"""cl AS (SELECT id AS call_site_id, crate_id AS client_id, {V._urn('operation', 'repository_identity', "'GET'", 'path')} AS operation_id FROM decl WHERE path IS NOT NULL AND crate_id IS NOT NULL)"""


def _clients(spark, d):
    """Explicit clients: every declaration with a path calls it with GET."""
    return V.declarations(spark, d).where("path IS NOT NULL AND crate_id IS NOT NULL").select(F.col("id").alias("call_site_id"), F.col("crate_id").alias("client_id"), S.stable_id("operation", "repository_identity", F.lit("GET"), "path").alias("operation_id"))


@query(f"WITH {V.CODE}, {_OPS}, {_CLIENTS} SELECT {V._urn('link', 'operation_id', 'client_id', 'call_site_id', chr(39) + 'explicit' + chr(39))} AS link_id, client_id, call_site_id, operation_id FROM cl WHERE operation_id IN (SELECT operation_id FROM op)")
def federate_confirmed(spark, d):
    return federation.federate_explicit(_clients(spark, d), _operations(spark, d))[0]


@query(f"WITH {V.CODE}, {_OPS}, {_CLIENTS} SELECT {V._urn('rejection', 'operation_id', 'client_id', 'call_site_id', chr(39) + 'operation_not_exposed' + chr(39))} AS rejection_id, client_id, call_site_id, operation_id, 'operation_not_exposed' AS reason FROM cl WHERE operation_id NOT IN (SELECT operation_id FROM op)")
def federate_rejected(spark, d):
    return federation.federate_explicit(_clients(spark, d), _operations(spark, d))[1]


@query(f"""WITH {V.CODE}, {_OPS}, h AS (SELECT title, operation_name, count(DISTINCT operation_id) AS n, min(operation_id) AS o FROM op GROUP BY 1, 2)
SELECT d.id AS call_site_id, CASE WHEN coalesce(n, 0) = 0 THEN 'heuristic_no_match' WHEN n = 1 THEN 'heuristic_requires_confirmation' ELSE 'heuristic_ambiguous' END AS outcome, CASE WHEN n = 1 THEN o END AS operation_id, coalesce(n, 0) AS candidates FROM decl d LEFT JOIN h ON h.title = d.repository_identity AND h.operation_name = d.path""")
def federate_heuristic(spark, d):
    clients = V.declarations(spark, d).select(F.col("id").alias("call_site_id"), F.col("repository_identity").alias("service_hint"), F.col("path").alias("operation_hint"))
    return federation.federate_heuristic(clients, _operations(spark, d))


@query(f"""WITH {V.CODE}, {_CLIENTS}, f AS (SELECT client_id, operation_id, count(*) AS n, count(DISTINCT call_site_id) AS k FROM cl GROUP BY 1, 2 HAVING count(*) > 1)
SELECT client_id, operation_id AS call_site_id, CASE WHEN k = 1 THEN 'invalid_declaration' ELSE 'identity_conflict' END AS problem FROM f""")
def declaration_conflicts(spark, d):
    rows = _clients(spark, d).select("client_id", F.col("operation_id").alias("call_site_id"), F.col("call_site_id").alias("fingerprint"))
    return federation.declaration_conflicts(rows)


@query(f"""WITH {V.CODE}, {_OPS}, {_CLIENTS}, h AS (SELECT title, operation_name, count(DISTINCT operation_id) AS n FROM op GROUP BY 1, 2)
SELECT 'clients' AS family, (SELECT count(*) FROM cl) AS rows UNION ALL SELECT 'links', (SELECT count(*) FROM cl WHERE operation_id IN (SELECT operation_id FROM op)) UNION ALL SELECT 'rejections', (SELECT count(*) FROM cl WHERE operation_id NOT IN (SELECT operation_id FROM op))
UNION ALL SELECT 'candidates', (SELECT count(*) FROM decl d JOIN h ON h.title = d.repository_identity AND h.operation_name = d.path WHERE n = 1) UNION ALL SELECT 'operations', (SELECT count(*) FROM op)""")
def federation_summary(spark, d):
    """The counters of the federation report."""
    return reports.summary(_federation(spark, d))


@query(f"""WITH {V.CODE}, {_OPS}, {_CLIENTS}, lk AS (SELECT * FROM cl WHERE operation_id IN (SELECT operation_id FROM op)), rj AS (SELECT * FROM cl WHERE operation_id NOT IN (SELECT operation_id FROM op)),
cd AS (SELECT min(operation_id) AS operation_id FROM op JOIN decl d ON op.title = d.repository_identity AND op.operation_name = d.path GROUP BY d.id HAVING count(DISTINCT operation_id) = 1)
SELECT 'links' AS family, operation_id AS id FROM lk WHERE operation_id NOT IN (SELECT operation_id FROM op) UNION ALL SELECT 'links', call_site_id FROM lk WHERE call_site_id NOT IN (SELECT call_site_id FROM cl)
UNION ALL SELECT 'rejections', call_site_id FROM rj WHERE call_site_id NOT IN (SELECT call_site_id FROM cl) UNION ALL SELECT 'candidates', operation_id FROM cd WHERE operation_id NOT IN (SELECT operation_id FROM op)""")
def federation_references(spark, d):
    """Ids of the federation report that nothing in it resolves: none."""
    f = _federation(spark, d)
    return reports.unresolved(f, [("links", "operation_id", "operations", "operation_id"), ("links", "call_site_id", "clients", "call_site_id"), ("rejections", "call_site_id", "clients", "call_site_id"), ("candidates", "operation_id", "operations", "operation_id")])


def _federation(spark, d):
    clients, operations = materialize(_clients(spark, d), "clients"), materialize(_operations(spark, d), "operations")
    links, rejections = federation.federate_explicit(clients, operations)
    candidates = federate_heuristic(spark, d).where("outcome = 'heuristic_requires_confirmation'")
    return {"clients": clients, "operations": operations, "links": links, "rejections": rejections, "candidates": candidates}


@query("""SELECT family, count(*) AS n FROM (SELECT nullif(regexp_extract(id, '^urn:[a-z][a-z0-9-]*:([a-z-]+):(?:sha256|blake3):[0-9a-f]{64}$', 1), '') AS family FROM (SELECT id FROM evidence UNION ALL SELECT id FROM semantic_entities UNION ALL SELECT declaration_id FROM framework_diagnostics)) GROUP BY 1""")
def id_families(spark, d):
    """Which family each id as written names, and how many name none."""
    ids = table(spark, d, "evidence").select("id").unionByName(table(spark, d, "semantic_entities").select("id")).unionByName(table(spark, d, "framework_diagnostics").select(F.col("declaration_id").alias("id")))
    return ids.groupBy(reports.family_of(F.col("id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


_SPLIT = "TIMESTAMP '1995-01-01'"
_FIELDS = f"""contract AS (SELECT '/' || p_brand AS json_pointer, bool_and(p_size > 45) AS required FROM part GROUP BY 1),
li AS (SELECT '/' || p_brand AS json_pointer, l_shipdate < {_SPLIT} AS old, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
pres AS (SELECT json_pointer, old, CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 'guaranteed_present' ELSE 'may_be_absent' END AS presence FROM li GROUP BY 1, 2)"""


def _presence(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/"), "p_brand").alias("json_pointer"), "p_size")
    contract = part.groupBy("json_pointer").agg(F.bool_and(F.col("p_size") > 45).alias("required"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    p = li.groupBy("json_pointer", (F.col("l_shipdate") < F.expr(_SPLIT)).alias("old")).agg(F.when(F.count_distinct("l_returnflag") == 3, "guaranteed_present").otherwise("may_be_absent").alias("presence"))
    return federation.presence_change(contract, p.where("old"), p.where("NOT old"))


_CHANGE = f"""{_FIELDS}, pc AS (SELECT c.json_pointer, coalesce(o.presence, 'unknown') AS baseline, coalesce(n.presence, 'unknown') AS target, c.required FROM contract c LEFT JOIN pres o ON o.json_pointer = c.json_pointer AND o.old LEFT JOIN pres n ON n.json_pointer = c.json_pointer AND NOT n.old),
chg AS (SELECT json_pointer, baseline, target, CASE WHEN baseline = 'unknown' AND target = 'unknown' THEN 'unresolved' WHEN baseline = target THEN 'none' WHEN baseline = 'guaranteed_present' AND target = 'may_be_absent' AND NOT required THEN 'breaking' ELSE 'unsupported' END AS classification FROM pc)"""


@query(f"WITH {_CHANGE} SELECT json_pointer, baseline, target, classification, CASE WHEN classification = 'breaking' THEN 'cmp.response.presence.undocumented-guarantee-removed/v1' END AS rule_id FROM chg")
def presence_change(spark, d):
    return _presence(spark, d)


@query(f"""WITH {_CHANGE}, cl AS (SELECT DISTINCT 's' || l_suppkey AS client_id, '/' || p_brand AS json_pointer, CASE WHEN s_acctbal < 0 THEN 'handles_absent' ELSE 'requires_present' END AS assumption FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT client_id, json_pointer, assumption, CASE WHEN assumption = 'handles_absent' THEN 'compatible' ELSE 'breaking' END AS effect, assumption = 'requires_present' AS affected FROM cl WHERE json_pointer IN (SELECT json_pointer FROM chg WHERE classification = 'breaking')""")
def client_assessment(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/"), "p_brand").alias("json_pointer"))
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "handles_absent").otherwise("requires_present").alias("assumption"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    clients = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("client_id"), "json_pointer", "assumption").distinct()
    return federation.client_assessment(_presence(spark, d), clients)


# ---------------------------------------------------------------- set operations


@query("SELECT l_partkey, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' UNION SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01') GROUP BY 1")
def identity_union(spark, d):
    t = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_shipdate") < F.expr(_SPLIT)).alias("old"))
    key = F.concat_ws("|", "l_partkey", "l_suppkey").alias("id")
    side = lambda c: t.where(c).select(key, "l_partkey", "l_suppkey").distinct()
    return integrity.identity_union(side("old"), side("NOT old"), "id")[0].groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.CACHE} SELECT 'added' AS side, repository_identity, path FROM new_rev n WHERE NOT EXISTS (SELECT 1 FROM old_rev o WHERE o.repository_identity = n.repository_identity AND o.path = n.path) UNION ALL SELECT 'removed', repository_identity, path FROM old_rev o WHERE NOT EXISTS (SELECT 1 FROM new_rev n WHERE o.repository_identity = n.repository_identity AND o.path = n.path)")
def set_difference(spark, d):
    k = ["repository_identity", "path"]
    a, b = V.revision(spark, d, "first").select(*k), V.revision(spark, d, "last").select(*k)
    return b.join(a, k, "left_anti").select(F.lit("added").alias("side"), *k).unionByName(a.join(b, k, "left_anti").select(F.lit("removed").alias("side"), *k))


@query(f"WITH {V.CACHE} SELECT repository_identity, path FROM old_rev INTERSECT SELECT repository_identity, path FROM new_rev")
def set_intersection(spark, d):
    k = ["repository_identity", "path"]
    return V.revision(spark, d, "first").select(*k).intersect(V.revision(spark, d, "last").select(*k))


@query(f"WITH {V.CODE} SELECT id, subject_id, capability FROM gap WHERE subject_id IS NULL OR subject_id NOT IN (SELECT id FROM decl WHERE target_binding = 'resolved_unique')")
def gap_removal(spark, d):
    """Gaps that stay after those of uniquely resolved declarations are dropped."""
    solved = V.declarations(spark, d).where("target_binding = 'resolved_unique'").select(F.col("id").alias("subject_id"))
    return V.gaps(spark, d).join(solved, "subject_id", "left_anti").select("id", "subject_id", "capability")


# ---------------------------------------------------------------- graph


@query(f"WITH RECURSIVE {V.CODE}, e AS (SELECT DISTINCT source, target FROM edge WHERE kind = 'CONTAINS'), cl AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM cl c JOIN e ON e.source = c.target) SELECT source, target FROM cl")
def transitive_closure(spark, d):
    return graph.transitive_closure(V.edges(spark, d).where("kind = 'CONTAINS'"))


@query(f"WITH RECURSIVE {V.CODE}, e AS (SELECT DISTINCT source, target FROM edge WHERE kind = 'CONTAINS'), cl AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM cl c JOIN e ON e.source = c.target) SELECT target AS node, count(*) AS ancestors FROM cl GROUP BY 1")
def ancestors(spark, d):
    up = graph.ancestors(graph.transitive_closure(V.edges(spark, d).where("kind = 'CONTAINS'")))
    return up.groupBy("node").agg(F.count(F.lit(1)).alias("ancestors"))


_SLICE = f"""WITH RECURSIVE {V.TRADE}, e AS (SELECT DISTINCT source, target FROM trade WHERE kind = 'CONTAINS'), cl AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM cl c JOIN e ON e.source = c.target),
p AS (SELECT source AS s, target AS t FROM cl WHERE source LIKE 'region/%' AND target LIKE 'customer/%'), dn AS (SELECT source AS s, target AS x FROM cl UNION SELECT s, s FROM p), up AS (SELECT target AS t, source AS x FROM cl UNION SELECT t, t FROM p)
SELECT DISTINCT p.s, p.t, e.source, e.target FROM p JOIN dn a ON a.s = p.s JOIN up b ON b.t = p.t AND b.x = a.x JOIN e ON e.source = a.x JOIN dn a2 ON a2.s = p.s AND a2.x = e.target JOIN up b2 ON b2.t = p.t AND b2.x = e.target"""


@query(_SLICE)
def path_slice(spark, d):
    e = V.trade_edges(spark, d).where("kind = 'CONTAINS'")
    closure = graph.transitive_closure(e)
    pairs = closure.where("source LIKE 'region/%' AND target LIKE 'customer/%'").select(F.col("source").alias("s"), F.col("target").alias("t"))
    return graph.path_slice(e, closure, pairs)


@query(f"WITH {V.TRADE} SELECT source AS callable, target AS other, 'out' AS direction FROM trade WHERE kind = 'DEFINES' UNION ALL SELECT target, source, 'in' FROM trade WHERE kind = 'DEFINES'")
def call_edges(spark, d):
    e = V.trade_edges(spark, d).where("kind = 'DEFINES'")
    seeds = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return graph.incident(e, seeds).select(F.col("seed").alias("callable"), "other", "direction")


@query(f"""WITH {V.CODE}, r AS (SELECT subject_id AS id, 'diagnosed' AS role FROM diag UNION SELECT subject_id, 'gap' FROM gap UNION SELECT local_target_id, 'target' FROM decl UNION SELECT lexical_owner_id, 'owner' FROM decl UNION SELECT unnest(evidence_ids), 'evidence' FROM decl)
SELECT id, string_agg(role, ',' ORDER BY role) AS roles FROM r WHERE id IS NOT NULL GROUP BY id""")
def navigation_roles(spark, d):
    f = V.declarations(spark, d)
    rows = [V.diagnostics(spark, d).select(F.col("subject_id").alias("id"), F.lit("diagnosed").alias("role")), V.gaps(spark, d).select(F.col("subject_id").alias("id"), F.lit("gap").alias("role")), f.select(F.col("local_target_id").alias("id"), F.lit("target").alias("role")), f.select(F.col("lexical_owner_id").alias("id"), F.lit("owner").alias("role")), f.select(F.explode("evidence_ids").alias("id"), F.lit("evidence").alias("role"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return graph.navigation_roles(out)


@query(f"""WITH {V.CODE} SELECT {V._urn('relationship', "'CONTAINS'", 'e.owner_id', 'e.id')} AS id, 'CONTAINS' AS kind, e.owner_id AS source, e.id AS target, 'rule.contains/v1' AS rule_version, array_to_string(list_sort([x FOR x IN [p.id, c.id] IF x IS NOT NULL]), ',') AS input_claim_ids
FROM ent e LEFT JOIN claim p ON p.subject_id = e.owner_id LEFT JOIN claim c ON c.subject_id = e.id WHERE e.owner_id IS NOT NULL""")
def containment_rule(spark, d):
    c = V.claims(spark, d).select("subject_id", F.col("id").alias("claim"))
    rows = V.entities(spark, d).where("owner_id IS NOT NULL").select(F.col("owner_id").alias("parent"), F.col("id").alias("child"))
    rows = rows.join(c.select(F.col("subject_id").alias("parent"), F.col("claim").alias("parent_claim")), "parent", "left").join(c.select(F.col("subject_id").alias("child"), F.col("claim").alias("child_claim")), "child", "left")
    return graph.containment(rows, "rule.contains/v1", S.stable_id("relationship", F.lit("CONTAINS"), "parent", "child"))


@query(f"WITH RECURSIVE {V.CODE}, ref AS (SELECT id, unnest(evidence_ids) AS t FROM decl UNION ALL SELECT id, local_target_id FROM decl WHERE local_target_id IS NOT NULL UNION ALL SELECT id, owner_id FROM ent WHERE owner_id IS NOT NULL), r AS (SELECT DISTINCT subject_id AS id FROM diag WHERE subject_id IS NOT NULL UNION SELECT ref.t FROM r JOIN ref ON ref.id = r.id) SELECT id FROM r")
def evidence_closure(spark, d):
    f = V.declarations(spark, d)
    refs = f.select("id", F.explode("evidence_ids").alias("evidence_id")).unionByName(f.where("local_target_id IS NOT NULL").select("id", F.col("local_target_id").alias("evidence_id"))).unionByName(V.entities(spark, d).where("owner_id IS NOT NULL").select("id", F.col("owner_id").alias("evidence_id")))
    return graph.evidence_closure(V.diagnostics(spark, d).select(F.col("subject_id").alias("id")), refs)


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM e)
SELECT CAST(user_id AS VARCHAR) AS callable, CAST(event_id AS VARCHAR) AS read_id, CAST(def AS VARCHAR) AS definition_id, 'must' AS mode FROM w WHERE event_type = 'view' AND def IS NOT NULL""")
def reaching_definitions(spark, d):
    """A user's purchases define, their views read, in blocks of one quarter of the stream joined in order."""
    ev = table(spark, d, "events").where("event_type IN ('purchase', 'view')")
    t = ev.select(F.col("user_id").cast("string").alias("callable"), F.col("event_id").cast("string").alias("op_id"), F.lit("basket").alias("binding"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"), F.struct("ts", "event_id").alias("ordinal"))
    bounds = ev.agg(F.expr("percentile_approx(unix_micros(CAST(ts AS TIMESTAMP)), array(0.25, 0.5, 0.75))").alias("q"))
    q = F.col("q")
    at = F.unix_micros(F.col("ordinal.ts").cast("timestamp"))
    ops = t.crossJoin(F.broadcast(bounds)).withColumn("block", ((at > q[0]).cast("int") + (at > q[1]).cast("int") + (at > q[2]).cast("int")).cast("long")).drop("q")
    users = ops.select("callable").distinct()
    flow = users.select("callable", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("source")).withColumn("target", F.col("source") + 1)
    return graph.reaching_definitions(ops, flow)


# ---------------------------------------------------------------- answers, documents, integrity


@query(None)
def function_context(spark, d):
    """The nested context of every declaration that has notes or calls: the flagship answer."""
    f = V.declarations(spark, d)
    callables = f.select("id", F.col("declared_key_or_target").alias("name"), F.col("lexical_owner_id").alias("owner_id"), F.try_element_at("evidence_ids", F.lit(1)).alias("evidence_id"))
    params = f.where("path IS NOT NULL").select(F.col("id").alias("callable"), F.posexplode(F.regexp_extract_all("path", F.lit(r"\{(\w+)\}"), F.lit(1))).alias("ordinal", "name"))
    body = f.select(F.col("id").alias("callable"), F.posexplode("evidence_ids").alias("ordinal", "evidence_id")).select("callable", "ordinal", F.col("evidence_id").alias("id"), F.lit("span").alias("kind"), "evidence_id")
    calls = materialize(V.edges(spark, d).where("kind = 'RESOLVES_TO'").select("id", "source", "target", F.lit(None).cast("string").alias("evidence_id")), "calls")
    context = answers.function_context(callables, params, body, calls, V.claims(spark, d), V.gaps(spark, d), V.evidence(spark, d))
    return answers.nest_context(context, context_signature(spark, d), answers.context_navigation(callables, body, calls), context_derivations(spark, d))


@query(f"""WITH {V.CODE} SELECT id AS callable, concat_ws(' ', 'fn ' || declared_key_or_target) || '(' || array_to_string(regexp_extract_all(coalesce(path, ''), '\\{{(\\w+)\\}}', 1), ', ') || ')' || coalesce(' -> ' || nullif(method, ''), '') AS signature FROM decl""")
def context_signature(spark, d):
    """The display text of every callable: its name, the parameters of its path, and its method as what it gives."""
    f = V.declarations(spark, d)
    none = F.lit(None).cast("string")
    params = F.regexp_extract_all(F.coalesce("path", F.lit("")), F.lit(r"\{(\w+)\}"), F.lit(1))
    return f.select(F.col("id").alias("callable"), S.display_signature(none, none, F.array().cast("array<string>"), F.col("declared_key_or_target"), params, F.col("method")).alias("signature"))


@query(f"""WITH {V.CODE}, nav AS (SELECT id AS callable, id AS member, 'callable' AS role FROM decl UNION SELECT id, lexical_owner_id, 'owner' FROM decl WHERE lexical_owner_id IS NOT NULL UNION SELECT id, unnest(evidence_ids), 'body_fact' FROM decl
  UNION SELECT source, target, 'callee' FROM edge WHERE kind = 'RESOLVES_TO' AND source IN (SELECT id FROM decl) UNION SELECT target, source, 'caller' FROM edge WHERE kind = 'RESOLVES_TO' AND target IN (SELECT id FROM decl))
SELECT callable, member AS id, string_agg(role, ',' ORDER BY role) AS roles FROM nav GROUP BY 1, 2""")
def context_navigation(spark, d):
    """Where one can go from each callable, and in which roles."""
    f = V.declarations(spark, d)
    callables = f.select("id", F.col("lexical_owner_id").alias("owner_id"))
    body = f.select(F.col("id").alias("callable"), F.explode("evidence_ids").alias("evidence_id"))
    return answers.context_navigation(callables, body, V.edges(spark, d).where("kind = 'RESOLVES_TO'").select("source", "target"))


@query(f"""WITH {V.CODE} SELECT e.id AS callable, {V._urn('relationship', "'CONTAINS'", 'e.owner_id', 'e.id')} AS relationship_id, unnest(CASE WHEN p.id IS NULL AND c.id IS NULL THEN [NULL] ELSE [x FOR x IN [p.id, c.id] IF x IS NOT NULL] END) AS claim_id
FROM ent e LEFT JOIN claim p ON p.subject_id = e.owner_id LEFT JOIN claim c ON c.subject_id = e.id WHERE e.owner_id IS NOT NULL AND e.id IN (SELECT id FROM decl)""")
def context_derivations(spark, d):
    """The derived relationship that holds each callable, with its input claims."""
    return answers.context_derivations(V.declarations(spark, d), containment_rule(spark, d))


@query(f"""WITH {V.CODE}, lost AS (SELECT DISTINCT id FROM (SELECT id, unnest(evidence_ids) AS e FROM decl) WHERE e NOT IN (SELECT id FROM evid))
SELECT d.id AS callable, d.id NOT IN (SELECT id FROM lost) AS complete, len(evidence_ids) AS body_facts FROM decl d""")
def context_completeness(spark, d):
    """Which contexts name nothing that is lost: parameters in order, evidence at hand, one signature."""
    c = function_context(spark, d)
    return c.select("callable", "complete", F.coalesce(F.size("body_facts"), F.lit(0)).cast("long").alias("body_facts"))


@query(f"""WITH {V.CODE}, call AS (SELECT source, count(*) AS n FROM edge WHERE kind = 'RESOLVES_TO' GROUP BY 1)
SELECT d.id AS callable, declared_key_or_target AS name, lexical_owner_id AS owner_id, len(evidence_ids) AS body_facts, coalesce(c.n, 0) AS outgoing, (SELECT count(DISTINCT capability) FROM gap g WHERE g.subject_id = d.id) AS gap_kinds, (SELECT count(*) FROM evid e WHERE list_contains(d.evidence_ids, e.id)) AS evidence FROM decl d LEFT JOIN call c ON c.source = d.id""")
def function_context_flat(spark, d):
    c = function_context(spark, d)
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return c.select("callable", "name", "owner_id", size("body_facts").alias("body_facts"), size("outgoing").alias("outgoing"), size("coverage_gaps").alias("gap_kinds"), size("evidence").alias("evidence"))


@query(f"""WITH {_FILES}, f AS (SELECT path, blob_oid, min(file_id) AS file_id, min(source_text) AS s FROM files WHERE source_text IS NOT NULL AND blob_oid IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_text) = 1),
e AS (SELECT file_id, path, blob_oid, s, CAST(length(s) // 3 AS BIGINT) AS a, CAST(2 * length(s) // 3 AS BIGINT) AS b FROM f)
SELECT CAST(file_id AS VARCHAR) AS evidence_id, substr(s, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER)) AS excerpt, CAST(length(left(s, a)) - length(replace(left(s, a), chr(10), '')) + 1 AS BIGINT) AS start_line, CAST(length(list_extract(string_split(left(s, a), chr(10)), -1)) + 1 AS BIGINT) AS start_column,
  CAST(length(left(s, b)) - length(replace(left(s, b), chr(10), '')) + 1 AS BIGINT) AS end_line, CAST(length(list_extract(string_split(left(s, b), chr(10)), -1)) + 1 AS BIGINT) AS end_column, sha256(substr(s, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER))) AS sha256, CAST(NULL AS VARCHAR) AS problem FROM e""")
def source_excerpt(spark, d):
    f = _files(spark, d).where("source_text IS NOT NULL AND blob_oid IS NOT NULL").groupBy("path", "blob_oid").agg(F.min("file_id").alias("file_id"), F.min("source_text").alias("s"), F.count_distinct("source_text").alias("n")).where("n = 1").withColumn("bytes", F.encode("s", "UTF-8"))
    size = F.octet_length("bytes")
    ev = f.select(F.col("file_id").cast("string").alias("id"), "path", "blob_oid", F.floor(size / 3).alias("start_byte"), F.floor(2 * size / 3).alias("end_byte"))
    return answers.source_excerpts(ev, f.select("path", "blob_oid", "bytes"))


@query(f"""WITH {V.CODE}, m AS (SELECT crate_id, module_path, count(*) AS statements, '# ' || coalesce(module_path, '(crate)') || chr(10) || chr(10) || string_agg('- `' || coalesce(name, '?') || '` (' || kind || ')', chr(10) ORDER BY kind, name NULLS FIRST, id) || chr(10) AS body FROM ent GROUP BY 1, 2)
SELECT crate_id, module_path, statements, body, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS byte_length FROM m""")
def docs_overview(spark, d):
    return answers.module_documents(V.entities(spark, d))


@query(f"WITH {V.CODE} SELECT crate_id, module_path, count(*) AS statements, md5(string_agg('- `' || coalesce(name, '?') || '` (' || kind || ')', chr(10) ORDER BY kind, name NULLS FIRST, id)) AS lines FROM ent GROUP BY 1, 2")
def docs_lines(spark, d):
    t = answers.module_documents(V.entities(spark, d))
    body = F.rtrim(F.regexp_replace("body", r"^# [^\n]*\n\n", ""), F.lit("\n"))
    return t.select("crate_id", "module_path", "statements", F.md5(body).alias("lines"))


@query(f"""WITH {V.CODE}, m AS (SELECT crate_id, module_path, count(*) AS n FROM ent GROUP BY 1, 2) SELECT 'sound' AS state, count(*) AS documents FROM m""")
def docs_validation(spark, d):
    """Generated documents held against their own manifest: bytes and digest of every body agree."""
    t = answers.module_documents(V.entities(spark, d))
    return answers.validate_documents(t.select("crate_id", "module_path", "sha256", "byte_length"), t.select("crate_id", "module_path", "body"), ["crate_id", "module_path"]).groupBy("state").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {V.CODE} SELECT id, path FROM evid WHERE id NOT IN (SELECT unnest(evidence_ids) FROM decl)")
def sweep_unreferenced(spark, d):
    refs = V.declarations(spark, d).select(F.explode("evidence_ids").alias("id"))
    return store.unreferenced(V.evidence(spark, d).select("id", "path"), refs, "id")


@query(f"""WITH {V.CODE} SELECT 'relationship.source_missing' AS rule, id AS subject_id FROM rawe WHERE source NOT IN (SELECT id FROM ent) UNION ALL SELECT 'relationship.target_missing', id FROM rawe WHERE target NOT IN (SELECT id FROM ent)
UNION ALL SELECT 'claim.subject_missing', id FROM claim WHERE subject_id NOT IN (SELECT id FROM ent) AND subject_id NOT IN (SELECT id FROM rawe) UNION ALL SELECT 'evidence.bad_span', id FROM evid WHERE start_byte < 0 OR end_byte < start_byte OR start_byte IS NULL OR end_byte IS NULL UNION ALL SELECT 'evidence.no_path', id FROM evid WHERE path IS NULL OR path = ''
UNION ALL SELECT 'relationship.duplicate_id', id FROM rawe GROUP BY id HAVING count(*) > 1""")
def violations(spark, d):
    ent = materialize(V.entities(spark, d).select("id", "owner_id"), "entities")
    rel = materialize(V.raw_edges(spark, d, ent), "edges")
    return integrity.violations(ent, rel, V.claims(spark, d), materialize(V.evidence(spark, d), "evidence"))


@query(f"""WITH {V.CODE}, f AS (SELECT 'entities' AS family, id, CAST(to_json([id, coalesce(crate_id, ''), coalesce(kind, ''), coalesce(module_path, ''), coalesce(name, ''), coalesce(owner_id, ''), coalesce(visibility, '')]) AS VARCHAR) AS entry FROM ent
  UNION ALL SELECT 'evidence', id, CAST(to_json([id, coalesce(blob_oid, ''), coalesce(CAST(end_byte AS VARCHAR), ''), coalesce(path, ''), coalesce(CAST(start_byte AS VARCHAR), '')]) AS VARCHAR) FROM evid
  UNION ALL SELECT 'relationships', id, CAST(to_json([id, kind, source, target]) AS VARCHAR) FROM edge),
p AS (SELECT family, substr(sha256(id), 1, 6) AS part, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h, count(*) AS n FROM f GROUP BY 1, 2),
q AS (SELECT family, substr(part, 1, 3) AS up, sha256(string_agg(h, chr(10) ORDER BY part)) AS uh, sum(n) AS n FROM p GROUP BY 1, 2)
SELECT family, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(uh, chr(10) ORDER BY up)) AS digest FROM q GROUP BY 1""")
def portable_manifest(spark, d):
    """Rows and digest of every family: what an export of the graph is checked by."""
    return store.portable_graph({"entities": V.entities(spark, d), "relationships": V.edges(spark, d), "evidence": V.evidence(spark, d)})
