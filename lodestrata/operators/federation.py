"""Cross-repository contract joins and API-compatibility impact.

Operations: operation_id, service, title, operation_name, method, path. Explicit clients bind by a key derived
from service, method and path; heuristic ones by the provider's title and operation name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import stable_id
from lodestrata.operators.resolve import trichotomy


def declaration_conflicts(clients: DataFrame) -> DataFrame:
    """Clients (client_id, call_site_id, fingerprint) declared more than once: invalid_declaration or identity_conflict."""
    g = clients.groupBy("client_id", "call_site_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("kinds")).where("n > 1")
    return g.select("client_id", "call_site_id", F.when(F.col("kinds") == 1, "invalid_declaration").otherwise("identity_conflict").alias("problem"))


def federate_explicit(clients: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed links, rejections) of explicit clients (client_id, call_site_id, operation_id)."""
    known = operations.select("operation_id").distinct()
    links = clients.join(known, "operation_id").select(stable_id("link", "operation_id", "client_id", "call_site_id", F.lit("explicit")).alias("link_id"), "client_id", "call_site_id", "operation_id")
    rejected = clients.join(known, "operation_id", "left_anti").select(
        stable_id("rejection", "operation_id", "client_id", "call_site_id", F.lit("operation_not_exposed")).alias("rejection_id"), "client_id", "call_site_id", "operation_id", F.lit("operation_not_exposed").alias("reason")
    )
    return links, rejected


def federate_heuristic(clients: DataFrame, operations: DataFrame) -> DataFrame:
    """Heuristic clients (call_site_id, service_hint, operation_hint) by the number of operations with that title and name."""
    refs = clients.select(F.col("call_site_id").alias("ref_id"), F.col("service_hint").alias("title"), F.col("operation_hint").alias("operation_name"))
    catalog = operations.select(F.col("operation_id").alias("id"), "title", "operation_name")
    out = trichotomy(refs, catalog, ["title", "operation_name"], ("heuristic_no_match", "heuristic_requires_confirmation", "heuristic_ambiguous"))
    return out.select(F.col("ref_id").alias("call_site_id"), F.col("state").alias("outcome"), F.col("target").alias("operation_id"), "candidates")


def presence_change(contract: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Classified presence change per field: ``contract`` (json_pointer, required), ``old``/``new`` (json_pointer, presence).

    Presence is guaranteed_present, may_be_absent or unknown; a field without a row is unknown.
    """
    rows = contract.join(old.select("json_pointer", F.col("presence").alias("o")), "json_pointer", "left").join(new.select("json_pointer", F.col("presence").alias("n")), "json_pointer", "left")
    o, n = F.coalesce("o", F.lit("unknown")), F.coalesce("n", F.lit("unknown"))
    kind = (
        F.when((o == "unknown") & (n == "unknown"), "unresolved")
        .when(o == n, "none")
        .when((o == "guaranteed_present") & (n == "may_be_absent") & ~F.col("required"), "breaking")
        .otherwise("unsupported")
    )
    rule = F.when(kind == "breaking", "cmp.response.presence.undocumented-guarantee-removed/v1")
    return rows.select("json_pointer", o.alias("baseline"), n.alias("target"), kind.alias("classification"), rule.alias("rule_id"))


def client_assessment(changes: DataFrame, clients: DataFrame) -> DataFrame:
    """Effect of breaking changes on clients (client_id, json_pointer, assumption): client_id, json_pointer, effect, affected."""
    rows = clients.join(changes.where("classification = 'breaking'").select("json_pointer"), "json_pointer", "left_semi")
    return rows.select("client_id", "json_pointer", "assumption", F.when(F.col("assumption") == "handles_absent", "compatible").otherwise("breaking").alias("effect"), (F.col("assumption") == "requires_present").alias("affected"))


def refresh_rule(plans: DataFrame, changes: DataFrame, stable: DataFrame) -> DataFrame:
    """The refresh rule of each plan: ``plans`` (plan_id, same_commit, compatible), ``changes`` (plan_id, path, change_kind, content_changed), ``stable`` (plan_id, path).

    Gives plan_id, outcome and rule_id. Changes without new content never widen the analysis.
    """
    known = stable.select("plan_id", "path").distinct().withColumn("__stable", F.lit(True))
    c = changes.join(known, ["plan_id", "path"], "left")
    # inputs of the map of modules: a change there can change which sources belong to which crate
    manifest = (F.col("path") == "Cargo.toml") | F.col("path").rlike(r"/(Cargo\.toml|src/lib\.rs|src/main\.rs|mod\.rs)$")
    rust = F.col("path").endswith(".rs")
    wide = F.col("content_changed") & (manifest | (rust & ((F.col("change_kind") != "modified") | F.col("__stable").isNull())))
    seen = c.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(wide).alias("wide"), F.bool_or(rust & F.col("content_changed")).alias("part"))
    rows = plans.join(seen, "plan_id", "left")
    none = F.coalesce("n", F.lit(0)) == 0
    outcome = (
        F.when(~F.col("compatible"), "full_rebuild")
        .when(F.col("same_commit") & none, "no_change")
        .when(F.coalesce("wide", F.lit(False)), "full_workspace_analysis")
        .when(F.coalesce("part", F.lit(False)), "partial_analysis")
        .otherwise("inventory_only")
    )
    number = F.when(outcome == "full_rebuild", "002").when(outcome == "full_workspace_analysis", "003").when(outcome == "partial_analysis", "004").when(outcome == "inventory_only", "005").otherwise("006")
    return rows.select("plan_id", outcome.alias("outcome"), F.concat(F.lit("INC-RULE-"), number).alias("rule_id"))


#: The rules a client's assessment names.
SAFE_RULE = "cmp.response.presence.safe-absence-handling/v1"
STRICT_RULE = "cmp.response.presence.client-stricter-than-contract/v1"
REMOVED_RULE = "cmp.response.presence.undocumented-guarantee-removed/v1"


def provider_changes(old_contract: DataFrame, new_contract: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Presence change of every field of an operation between two revisions: operation_id, json_pointer, baseline, target, classification, rule_id, gap.

    Contracts: operation_id, json_pointer, required; implementations: operation_id, json_pointer, presence, where
    pointer ``*`` stands for a custom mapping. A field that only one contract has, or whose requiredness moved,
    is unsupported: the contracts' keys must be equal. A field of unknown presence on both sides is
    unresolved, with a gap where a custom mapping explains it.
    """
    on = ["operation_id", "json_pointer"]
    rows = old_contract.select(*on, F.col("required").alias("r0")).join(new_contract.select(*on, F.col("required").alias("r1")), on, "full_outer")
    for df, name in ((old, "o"), (new, "n")):
        rows = rows.join(df.where("json_pointer <> '*'").select(*on, F.col("presence").alias(name)), on, "left")
    custom = old.unionByName(new).where("json_pointer = '*'").select("operation_id").distinct().withColumn("custom", F.lit(True))
    rows = rows.join(custom, "operation_id", "left")
    o, n = F.coalesce("o", F.lit("unknown")), F.coalesce("n", F.lit("unknown"))
    kind = (
        F.when(F.col("r0").isNull() | F.col("r1").isNull() | (F.col("r0") != F.col("r1")), "unsupported")
        .when((o == "unknown") & (n == "unknown"), "unresolved").when(o == n, "none")
        .when((o == "guaranteed_present") & (n == "may_be_absent") & ~F.col("r0"), "breaking").otherwise("unsupported")
    )
    return rows.select(*on, o.alias("baseline"), n.alias("target"), kind.alias("classification"), F.when(kind == "breaking", REMOVED_RULE).alias("rule_id"), F.when((kind == "unresolved") & F.col("custom"), "provider.custom_mapping").alias("gap"))


def classify_clients(clients: DataFrame, changes: DataFrame, contracts: DataFrame) -> DataFrame:
    """What a breaking change means for each client: client_id, call_site_id, state, baseline_risk, target_impact, affected, rule_ids.

    ``clients``: client_id, call_site_id, federation (confirmed, rejected), operation_id, path_template, assumptions
    (map of pointer to assumption); ``changes`` of :func:`provider_changes`; ``contracts``: operation_id, path_template.
    A confirmed client of the changed operation and path is assessed, a rejected one of another path is a rejected
    candidate, an assumption that is unknown or missing is unsupported, and all else has no authority.
    """
    broken = changes.where("classification = 'breaking'").join(contracts, "operation_id").select(F.col("operation_id").alias("changed"), "json_pointer", F.col("path_template").alias("path"))
    # a rejected client names an operation that nobody exposes: it is held against every changed one, of which a report has one
    confirmed = clients.where("federation = 'confirmed'").join(broken, F.col("operation_id") == F.col("changed"), "left")
    how = F.try_element_at("assumptions", F.col("json_pointer"))
    right = F.col("changed").isNotNull() & (F.col("path_template") == F.col("path"))
    state = F.when(~right, "invalid_authority").when(how == "handles_absent", "assessed").when(how == "requires_present", "assessed").otherwise("unsupported")
    strict = right & (how == "requires_present")
    a = confirmed.select(
        "client_id", "call_site_id", state.alias("state"), F.when(state == "assessed", F.when(strict, "potentially_breaking").otherwise("compatible")).alias("baseline_risk"),
        F.when(state == "assessed", F.when(strict, "breaking").otherwise("compatible")).alias("target_impact"), F.when(state == "assessed", strict).alias("affected"),
        F.when(state == "assessed", F.when(strict, f"{STRICT_RULE},{REMOVED_RULE}").otherwise(SAFE_RULE)).alias("rule_ids"),
    )
    paths = broken.select(F.col("path").alias("path_template"), F.lit(True).alias("same")).distinct()
    none = lambda t: F.lit(None).cast(t)
    b = clients.where("federation <> 'confirmed'").join(paths, "path_template", "left").select(
        "client_id", "call_site_id", F.when(F.col("same").isNull() & (F.col("federation") == "rejected"), "rejected_candidate").otherwise("invalid_authority").alias("state"),
        none("string").alias("baseline_risk"), none("string").alias("target_impact"), none("boolean").alias("affected"), none("string").alias("rule_ids"),
    )
    return a.unionByName(b)


def affected_clients(changes: DataFrame, clients: DataFrame, assessments: DataFrame) -> DataFrame:
    """Each breaking change with its affected clients, sorted: operation_id, json_pointer, affected_client_ids."""
    hit = assessments.where("affected").select("client_id").join(clients.select("client_id", "operation_id"), "client_id")
    ids = hit.groupBy("operation_id").agg(F.array_sort(F.collect_set("client_id")).alias("affected_client_ids"))
    rows = changes.where("classification = 'breaking'").join(ids, "operation_id", "left")
    return rows.select("operation_id", "json_pointer", F.coalesce("affected_client_ids", F.array().cast("array<string>")).alias("affected_client_ids"))


def impact_guard(baseline: DataFrame, target: DataFrame, changes: DataFrame) -> DataFrame:
    """Why an operation's comparison may not be made, or null: operation_id, problem.

    Both sides: operation_id, revision, contract_sha256, service_id, path_template, method, response_status. Revisions
    must differ, all else agree, the method be GET and the status 200, and exactly one change be breaking.
    """
    same = ["contract_sha256", "service_id", "path_template", "method", "response_status"]
    rows = baseline.join(target.select("operation_id", *[F.col(c).alias(f"t_{c}") for c in ("revision", *same)]), "operation_id", "left")
    n = changes.where("classification = 'breaking'").groupBy("operation_id").agg(F.count(F.lit(1)).alias("breaking"))
    rows = rows.join(n, "operation_id", "left")
    problem = F.when(F.col("t_revision").isNull(), "no_target").when(F.col("revision") == F.col("t_revision"), "same_revision")
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"t_{c}")), f"{c}_differs")
    problem = problem.when(F.col("method") != "GET", "method").when(F.col("response_status") != "200", "response_status").when(F.coalesce("breaking", F.lit(0)) != 1, "not_one_breaking_change")
    return rows.select("operation_id", problem.alias("problem"))
