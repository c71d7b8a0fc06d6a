"""Answers about single ids: exact lookup, function context, source excerpts, generated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import is_char_boundary, line_column

#: Fixed value: the order in which the families are asked for an id.
PRECEDENCE = ("entity", "relationship", "claim", "evidence", "diagnostic", "coverage_gap", "document")


class Incomplete(ValueError):
    """A function context that names something nothing holds."""


class UnknownId(LookupError):
    """No family holds the id."""


def family_index(families: dict[str, DataFrame]) -> DataFrame:
    """id, rank, family of all ids of the families given, each with an id column."""
    out = None
    for i, f in enumerate(PRECEDENCE):
        if f in families:
            part = families[f].select("id").distinct().select("id", F.lit(i).alias("rank"), F.lit(f).alias("family"))
            out = part if out is None else out.unionByName(part)
    return out


def lookup(ids: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """``ids`` (id): the first family by precedence that holds it, null where none does."""
    hit = family_index(families).groupBy("id").agg(F.min_by("family", "rank").alias("family"))
    return ids.select("id").distinct().join(hit, "id", "left")


def lookup_one(one: str, families: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """(family, its row) of one id: the filter reaches the scans. An unknown id raises."""
    for f in PRECEDENCE:
        if f in families:
            row = families[f].where(F.col("id") == one)
            if row.head(1):
                return f, row
    raise UnknownId(one)


def function_context(callables: DataFrame, parameters: DataFrame, body: DataFrame, calls: DataFrame, claims: DataFrame, gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested row per callable: what is known about it.

    callables (id, name, owner_id, evidence_id), parameters (callable, ordinal, name), body (callable, ordinal,
    id, kind, evidence_id), calls (id, source, target, evidence_id), claims (id, subject_id, state), gaps
    (subject_id, capability), evidence (id, path, start_byte, end_byte). Lists are sorted; ``complete`` is false
    where parameters are not numbered 0..n-1 or evidence is missing.
    """
    params = parameters.groupBy("callable").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("parameters"), F.count(F.lit(1)).alias("np"), F.min("ordinal").alias("pmin"), F.max("ordinal").alias("pmax"), F.count_distinct("ordinal").alias("pd"))
    facts = body.groupBy("callable").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "kind"))).alias("body_facts"))
    out_calls = calls.groupBy(F.col("source").alias("callable")).agg(F.array_sort(F.collect_set("target")).alias("outgoing"))
    in_calls = calls.groupBy(F.col("target").alias("callable")).agg(F.array_sort(F.collect_set("source")).alias("incoming"))
    subjects = callables.select(F.col("id").alias("callable"), F.col("id").alias("subject_id")).unionByName(body.select("callable", F.col("id").alias("subject_id"))).unionByName(calls.select(F.col("source").alias("callable"), F.col("id").alias("subject_id"))).distinct()
    claimed = subjects.join(claims, "subject_id").groupBy("callable").agg(F.array_sort(F.collect_set(F.struct("id", "state"))).alias("claims"))
    gapped = subjects.join(gaps, "subject_id").groupBy("callable").agg(F.array_sort(F.collect_set("capability")).alias("coverage_gaps"))
    wanted = callables.select(F.col("id").alias("callable"), "evidence_id").unionByName(body.select("callable", "evidence_id")).unionByName(calls.select(F.col("source").alias("callable"), "evidence_id")).where("evidence_id IS NOT NULL").distinct()
    found = wanted.join(evidence.withColumnRenamed("id", "evidence_id"), "evidence_id", "left").groupBy("callable").agg(
        F.array_sort(F.collect_set(F.when(F.col("path").isNotNull(), F.struct("evidence_id", "path", "start_byte", "end_byte")))).alias("evidence"), F.count(F.when(F.col("path").isNull(), 1)).alias("lost")
    )
    rows = callables.select(F.col("id").alias("callable"), "name", "owner_id")
    for part in (params, facts, out_calls, in_calls, claimed, gapped, found):
        rows = rows.join(part, "callable", "left")
    numbered = F.col("np").isNull() | ((F.col("pmin") == 0) & (F.col("pmax") == F.col("np") - 1) & (F.col("pd") == F.col("np")))
    return rows.withColumn("complete", numbered & (F.coalesce("lost", F.lit(0)) == 0)).drop("np", "pmin", "pmax", "pd", "lost")


def context_navigation(callables: DataFrame, body: DataFrame, calls: DataFrame) -> DataFrame:
    """What one can go to from each callable: callable, id, roles (sorted, joined by commas).

    The callable itself, its owner, the evidence of its body facts, what it calls (callee) and what calls it (caller).
    """
    of = callables.select(F.col("id").alias("callable"))
    role = lambda df, c, m, name: df.select(F.col(c).alias("callable"), F.col(m).alias("id"), F.lit(name).alias("role"))
    rows = role(callables, "id", "id", "callable").unionByName(role(callables, "id", "owner_id", "owner")).unionByName(role(body, "callable", "evidence_id", "body_fact"))
    rows = rows.unionByName(role(calls, "source", "target", "callee").join(of, "callable", "left_semi")).unionByName(role(calls, "target", "source", "caller").join(of, "callable", "left_semi"))
    return rows.where("callable IS NOT NULL AND id IS NOT NULL").groupBy("callable", "id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def context_derivations(callables: DataFrame, derivations: DataFrame) -> DataFrame:
    """The derived relationships that end in each callable, with the claims they were derived from: callable, relationship_id, claim_id (null where none is known)."""
    d = derivations.select(F.col("target").alias("callable"), F.col("id").alias("relationship_id"), F.explode_outer(F.filter(F.split("input_claim_ids", ","), lambda c: c != "")).alias("claim_id"))
    return d.join(callables.select(F.col("id").alias("callable")), "callable", "left_semi")


def nest_context(contexts: DataFrame, display: DataFrame, navigation: DataFrame, derivations: DataFrame) -> DataFrame:
    """Contexts of :func:`function_context` with signature, navigation and derivations nested in.

    ``display``: callable, signature; a callable with none, or with several, is not complete.
    """
    one = display.groupBy("callable").agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("__s"))
    nav = navigation.groupBy("callable").agg(F.array_sort(F.collect_list(F.struct("id", "roles"))).alias("navigation"))
    der = derivations.groupBy("callable").agg(F.array_sort(F.collect_set(F.struct("relationship_id", "claim_id"))).alias("derivations"))
    rows = contexts.join(one, "callable", "left").join(nav, "callable", "left").join(der, "callable", "left")
    return rows.withColumn("complete", F.col("complete") & F.coalesce(F.col("__s") == 1, F.lit(False))).drop("__s")


def require_complete(contexts: DataFrame) -> DataFrame:
    """``contexts`` if all of them are complete; else an error that names one, never a context with holes."""
    lost = contexts.where("NOT complete").select("callable").head(1)
    if lost:
        raise Incomplete(lost[0]["callable"])
    return contexts


def source_excerpts(evidence: DataFrame, files: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """The exact text of evidence spans: evidence_id, excerpt, start_line, start_column, end_line, end_column, sha256, problem.

    ``evidence`` (id, path, blob_oid, start_byte, end_byte) against ``files`` (path, blob_oid, bytes), unique by
    both. A span outside the file, inside a character or longer than ``limit`` bytes has a problem and no text.
    """
    e = evidence.select(F.col("id").alias("evidence_id"), "path", "blob_oid", "start_byte", "end_byte")
    rows = e.join(files.select("path", "blob_oid", "bytes"), ["path", "blob_oid"], "left")
    size = F.octet_length("bytes")
    problem = (
        F.when(F.col("bytes").isNull(), "no_file")
        .when((F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte")) | (F.col("end_byte") > size), "out_of_range")
        .when(F.col("end_byte") - F.col("start_byte") > limit, "too_long")
        .when(~is_char_boundary(F.col("bytes"), F.col("start_byte")) | ~is_char_boundary(F.col("bytes"), F.col("end_byte")), "inside_character")
    )
    cut = F.substring(F.col("bytes"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    ok = problem.isNull()
    a, b = line_column(F.col("bytes"), F.col("start_byte")), line_column(F.col("bytes"), F.col("end_byte"))
    return rows.select(
        "evidence_id", F.when(ok, F.decode(cut, "UTF-8")).alias("excerpt"), F.when(ok, a["line"]).alias("start_line"), F.when(ok, a["column"]).alias("start_column"),
        F.when(ok, b["line"]).alias("end_line"), F.when(ok, b["column"]).alias("end_column"), F.when(ok, F.sha2(cut, 256)).alias("sha256"), problem.alias("problem"),
    )


def module_documents(entities: DataFrame) -> DataFrame:
    """One Markdown document per (crate_id, module_path): each entity one grounded line, in order of kind and name.

    A module's own lines make up its document, so its size is the module's.
    """
    line = F.concat(F.lit("- `"), F.coalesce("name", F.lit("?")), F.lit("` ("), F.col("kind"), F.lit(")"))
    g = entities.groupBy("crate_id", "module_path").agg(F.array_sort(F.collect_list(F.struct(F.col("kind"), F.col("name"), F.col("id"), line.alias("line")))).alias("rows"), F.count(F.lit(1)).alias("statements"))
    text = F.concat(F.lit("# "), F.coalesce("module_path", F.lit("(crate)")), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return g.select("crate_id", "module_path", "statements", text.alias("body")).withColumn("sha256", F.sha2("body", 256)).withColumn("byte_length", F.octet_length("body").cast("long"))


def validate_documents(manifest: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, state: sound, digest_differs, no_body or no_manifest; ``manifest`` has sha256 and byte_length, ``bodies`` body."""
    m = manifest.select(*[F.col(k).alias(f"m_{k}") for k in keys], "sha256", "byte_length", F.lit(True).alias("__m"))
    b = bodies.select(*keys, "body", F.lit(True).alias("__b"))
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    rows = b.join(m, on, "full_outer")
    same = (F.sha2("body", 256) == F.col("sha256")) & (F.octet_length("body") == F.col("byte_length"))
    state = F.when(F.col("__b").isNull(), "no_body").when(F.col("__m").isNull(), "no_manifest").when(same, "sound").otherwise("digest_differs")
    return rows.select(*[F.coalesce(F.col(k), F.col(f"m_{k}")).alias(k) for k in keys], state.alias("state"))


def bind_documents(bound: DataFrame, inventory: DataFrame) -> DataFrame:
    """Documents of a compiler index against the inventory: path, state (bound, missing, differs).

    Both have path, blob_oid, byte_length, sha256; a path that the inventory holds more than once is ambiguous.
    """
    mine = ["blob_oid", "byte_length", "sha256"]
    inv = inventory.groupBy("path").agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(f"__{c}") for c in mine])
    same = F.lit(True)
    for c in mine:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").when(same, "bound").otherwise("differs")
    return bound.join(inv, "path", "left").select("path", state.alias("state"))


def members(ids: DataFrame, families: dict[str, DataFrame], kinds: list[str] | None = None, through: str | None = None, derivations: DataFrame | None = None, siblings: DataFrame | None = None) -> DataFrame:
    """The members of each id's answer: id, family, member_id, each once.

    The record itself, in the first family that holds it; its claims, their evidence, its diagnostics and gaps; the
    relationships of ``kinds`` that touch it and the entities at their other ends, with their claims; beyond them one
    more step along edges of kind ``through``; derivations (relationship_id, derivation_id) of those relationships;
    and siblings (id, sibling_id) of the same logical declaration. ``families`` has entity, relationship (source,
    target, kind), claim (subject_id, evidence_ids), evidence, diagnostic and coverage_gap (subject_id). An id that
    no family holds has no member; a gap or claim without evidence has its other members all the same.
    """
    known = lookup(ids, families).where("family IS NOT NULL")
    own = known.select("id", "family", F.col("id").alias("member_id"))
    seeds = known.select("id")
    edges = families["relationship"].where(F.col("kind").isin(kinds)) if kinds is not None else families["relationship"]
    ends = edges.select("source", "target", F.col("id").alias("rid"))
    out = ends.join(seeds.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("id"), "rid", F.col("target").alias("other"))
    back = ends.join(seeds.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("target").alias("id"), "rid", F.col("source").alias("other"))
    touch = out.unionByName(back)
    parts = [own, touch.select("id", F.lit("relationship").alias("family"), F.col("rid").alias("member_id")), touch.select("id", F.lit("entity").alias("family"), F.col("other").alias("member_id"))]
    if through:
        step = families["relationship"].where(F.col("kind") == through).select(F.col("source").alias("other"), F.col("id").alias("rid2"), F.col("target").alias("far"))
        second = touch.select("id", "other").distinct().join(step, "other")
        parts += [second.select("id", F.lit("relationship").alias("family"), F.col("rid2").alias("member_id")), second.select("id", F.lit("entity").alias("family"), F.col("far").alias("member_id"))]
    if siblings is not None:
        parts.append(siblings.join(seeds, "id", "left_semi").select("id", F.lit("entity").alias("family"), F.col("sibling_id").alias("member_id")))
    linked = parts[0]
    for p in parts[1:]:
        linked = linked.unionByName(p)
    linked = linked.distinct()
    subjects = linked.select("id", F.col("member_id").alias("subject_id"))
    claims = subjects.join(families["claim"].select("subject_id", F.col("id").alias("member_id"), "evidence_ids"), "subject_id")
    result = linked.unionByName(claims.select("id", F.lit("claim").alias("family"), "member_id")).unionByName(claims.select("id", F.lit("evidence").alias("family"), F.explode("evidence_ids").alias("member_id")))
    for f in ("diagnostic", "coverage_gap"):
        result = result.unionByName(known.select(F.col("id").alias("subject_id")).join(families[f].select("subject_id", F.col("id").alias("member_id")), "subject_id").select(F.col("subject_id").alias("id"), F.lit(f).alias("family"), "member_id"))
    if derivations is not None:
        result = result.unionByName(linked.where("family = 'relationship'").join(derivations.select(F.col("relationship_id").alias("member_id"), "derivation_id"), "member_id").select("id", F.lit("derivation").alias("family"), F.col("derivation_id").alias("member_id")))
    return result.where("member_id IS NOT NULL").distinct()


def stale_documents(documents: DataFrame, heads: DataFrame) -> DataFrame:
    """Documents (document_id, repository, snapshot_id) against the heads (repository, snapshot_id): document_id, state (current, stale, unbound)."""
    h = heads.select("repository", F.col("snapshot_id").alias("__head"))
    rows = documents.join(h, "repository", "left")
    return rows.select("document_id", F.when(F.col("__head").isNull(), "unbound").when(F.col("snapshot_id").eqNullSafe(F.col("__head")), "current").otherwise("stale").alias("state"))


def explorer_index(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What a viewer's index holds of each entity: id, kind, name, search (lower case), out_edges, in_edges."""
    n = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = n.groupBy("id").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return entities.select("id", "kind", "name").join(n, "id", "left").select("id", "kind", "name", F.lower("name").alias("search"), zero("out_edges"), zero("in_edges"))
