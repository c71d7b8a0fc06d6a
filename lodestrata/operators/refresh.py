"""What an incremental refresh did: chunks and documents made anew, rules escalated, identities invalidated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.inventory import identity_delta


def chunk_rematerialisation(baseline: DataFrame, target: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks that both revisions have: source_file_id, analysis_action, baseline_hash, target_hash.

    ``baseline`` and ``target``: source_file_id (unique), hash. ``records``: source_file_id, reused. A chunk that no
    record tells of has a null action: the analysis is not complete.
    """
    b = baseline.select("source_file_id", F.col("hash").alias("baseline_hash"))
    rows = target.select("source_file_id", F.col("hash").alias("target_hash")).join(b, "source_file_id").join(records.select("source_file_id", "reused"), "source_file_id", "left")
    return rows.select("source_file_id", F.when(F.col("reused"), "reused").when(~F.col("reused"), "recomputed").alias("analysis_action"), "baseline_hash", "target_hash")


def document_rematerialisation(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Documents that both revisions have: document_id, path, baseline_hash, target_hash, content_changed."""
    b = baseline.select("document_id", F.col("hash").alias("baseline_hash"))
    rows = target.select("document_id", "path", F.col("hash").alias("target_hash")).join(b, "document_id")
    return rows.withColumn("content_changed", ~F.col("baseline_hash").eqNullSafe(F.col("target_hash")))


def changed_documents(baseline: DataFrame, target: DataFrame, group: str) -> DataFrame:
    """Per ``group`` the target's documents and how many have other or new content."""
    b = baseline.select("document_id", F.col("hash").alias("__b"), F.lit(True).alias("__there"))
    rows = target.select(group, "document_id", "hash").join(b, "document_id", "left")
    changed = F.col("__there").isNull() | ~F.col("__b").eqNullSafe(F.col("hash"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(changed, 1)).alias("changed"))


def escalate(rules: DataFrame, baseline_modules: DataFrame, target_modules: DataFrame, group: str) -> DataFrame:
    """``rules`` (plan_id, group, outcome) with the outcome raised where a group's modules differ between revisions.

    A partial analysis or an inventory alone can't tell which sources belong to a changed map of modules.
    """
    differ = baseline_modules.select(group, "module").distinct().exceptAll(target_modules.select(group, "module").distinct()).unionByName(
        target_modules.select(group, "module").distinct().exceptAll(baseline_modules.select(group, "module").distinct())
    ).select(group).distinct().withColumn("__moved", F.lit(True))
    raised = F.col("outcome").isin("partial_analysis", "inventory_only") & F.coalesce("__moved", F.lit(False))
    return rules.join(differ, group, "left").select("plan_id", group, F.when(raised, "full_workspace_analysis").otherwise(F.col("outcome")).alias("outcome"), raised.alias("escalated"))


def invalidation_report(families: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """family, retained, added, removed, invalidated of every family of identities: (baseline, target), each id, value, unique by id."""
    out = None
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    for name, (old, new) in sorted(families.items()):
        rows = identity_delta(old, new, "id", "value").agg(is_("retained"), is_("added"), is_("removed"), F.count(F.when(F.col("invalidated"), 1)).alias("invalidated"))
        part = rows.select(F.lit(name).alias("family"), *rows.columns)
        out = part if out is None else out.unionByName(part)
    return out
