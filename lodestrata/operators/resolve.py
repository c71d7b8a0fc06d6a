"""Resolution of names, scopes and spans: the joins that must end in exactly one partner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.skew import hot_keys

#: Width of the cells that bring spans together; a span lies in every cell it touches.
CELL = 4_096
#: Sub-keys over which a hot key is spread.
SALTS = 16


def probe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``left`` join ``right`` on ``on``, with the keys salted that a large share of ``left`` has.

    ``right`` has few rows of a key. Rows of a hot key are spread by their other columns.
    """
    hot = hot_keys(left, F.xxhash64(*on))
    if not hot:
        return left.join(right, on, how)
    rest = [c for c in left.columns if c not in on]
    is_hot = F.xxhash64(F.xxhash64(*on)).isin(hot)
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rest), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def _cells(start: str, end: str) -> F.Column:
    first, last = F.floor(F.col(start) / CELL), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / CELL)
    return F.explode(F.sequence(first, last))


def containing(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of spans where ``outer`` contains ``inner``: ``on``, inner_id, outer_id, width, outer_start, outer_end.

    Both have ``on``, id, start, end (half-open bytes). The equality on ``on`` and the cell of the inner span's
    start keeps the candidates few; spans that end before they start contain and are nothing.
    """
    i = inner.where("start <= end").select(*on, F.col("id").alias("inner_id"), F.col("start").alias("a"), F.col("end").alias("b"), F.floor(F.col("start") / CELL).alias("cell"))
    o = outer.where("start <= end").select(*on, F.col("id").alias("outer_id"), F.col("start").alias("outer_start"), F.col("end").alias("outer_end"), _cells("start", "end").alias("cell"))
    return probe(i, o, [*on, "cell"], "inner").where("outer_start <= a AND b <= outer_end").select(*on, "inner_id", "outer_id", (F.col("outer_end") - F.col("outer_start")).alias("width"), "outer_start", "outer_end")


def sole_owner(pairs: DataFrame) -> DataFrame:
    """Of (inner_id, outer_id) pairs: inner_id, owner_id (the only distinct one, else null), owners (their number)."""
    own = pairs.select("inner_id", "outer_id").distinct().groupBy("inner_id").agg(F.count(F.lit(1)).alias("owners"), F.min("outer_id").alias("o"))
    return own.select("inner_id", F.when(F.col("owners") == 1, F.col("o")).alias("owner_id"), "owners")


def narrowest(pairs: DataFrame) -> DataFrame:
    """Of containing pairs the narrowest outer span, the latest start among equals: inner_id, outer_id, shadowed.

    Where two outer ids have that very span, none is taken and ``shadowed`` is true.
    """
    best = pairs.groupBy("inner_id").agg(F.min(F.struct("width", -F.col("outer_start"), "outer_id")).alias("lo"), F.max(F.struct(-F.col("width"), "outer_start", "outer_id")).alias("hi"))
    tie = F.col("lo.outer_id") != F.col("hi.outer_id")
    return best.select("inner_id", F.when(~tie, F.col("lo.outer_id")).alias("outer_id"), tie.alias("shadowed"))


def two_tier(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls`` (call_id, crate, module, name, qualified) against ``names`` (id, crate, module, name): call_id, target, tier.

    An exact (crate, module, name) wins if it is the only one; an unqualified name may else be the only one
    of its crate. Anything else is unresolved.
    """
    exact = names.groupBy("crate", "module", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("t1")).where("n = 1").drop("n")
    crate = names.groupBy("crate", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("t2")).where("n = 1").drop("n")
    out = probe(probe(calls, exact, ["crate", "module", "name"]), crate, ["crate", "name"])
    second = F.when(~F.col("qualified"), F.col("t2"))
    return out.select("call_id", F.coalesce("t1", second).alias("target"), F.when(F.col("t1").isNotNull(), "exact").when(second.isNotNull(), "crate").otherwise("unresolved").alias("tier"))


def sole_kind(imports: DataFrame, names: DataFrame) -> DataFrame:
    """``imports`` (import_id, path) against ``names`` (path, kind, id): a target only where exactly one kind matches."""
    hits = names.select("path", "kind", "id").distinct().groupBy("path").agg(F.count_distinct("kind").alias("kinds"), F.min("id").alias("hit"))
    out = probe(imports, hits, ["path"])
    return out.select("import_id", F.when(F.col("kinds") == 1, F.col("hit")).alias("target"), F.when(F.col("kinds") == 1, "resolved").otherwise("unresolved").alias("resolution"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"))


def trichotomy(refs: DataFrame, catalog: DataFrame, on: list[str], states: tuple[str, str, str]) -> DataFrame:
    """``refs`` (ref_id, on...) by the number of partners in ``catalog`` (id, on...): none, one or several.

    The catalog is counted per key first, so a key with many partners never multiplies rows.
    """
    n = catalog.select("id", *on).distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__id"))
    out = probe(refs, n, on)
    c = F.coalesce("__n", F.lit(0)).cast("long")
    return out.select("ref_id", F.when(c == 0, states[0]).when(c == 1, states[1]).otherwise(states[2]).alias("state"), F.when(c == 1, F.col("__id")).alias("target"), c.alias("candidates"))


def unique_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_id, right_id where the key is on exactly one row of each side (id, key)."""
    one = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return one(left, "left_id").join(one(right, "right_id"), key)


def module_file(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``modules`` (module: a path without suffix) against ``files`` (path): module, state, path.

    A module is in ``m.rs`` or ``m/mod.rs``; in both it is ambiguous, in neither missing.
    """
    f = files.select("path").distinct()
    flat = f.select(F.regexp_replace("path", r"\.rs$", "").alias("module"), F.col("path").alias("__flat")).where("__flat LIKE '%.rs'")
    nested = f.where("path LIKE '%/mod.rs'").select(F.regexp_replace("path", r"/mod\.rs$", "").alias("module"), F.col("path").alias("__nested"))
    out = modules.select("module").distinct().join(flat, "module", "left").join(nested, "module", "left")
    both = F.col("__flat").isNotNull() & F.col("__nested").isNotNull()
    return out.select("module", F.when(both, "ambiguous").when(F.coalesce("__flat", "__nested").isNull(), "missing").otherwise("resolved").alias("state"), F.when(~both, F.coalesce("__flat", "__nested")).alias("path"))


def sole_claim(subjects: DataFrame, claims: DataFrame) -> DataFrame:
    """``subjects`` (id) with their only claim: id, claim_id, state (claimed, missing, ambiguous)."""
    n = claims.where("subject_id IS NOT NULL").groupBy(F.col("subject_id").alias("id")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("c"))
    out = subjects.select("id").distinct().join(n, "id", "left")
    return out.select("id", F.when(F.col("n") == 1, F.col("c")).alias("claim_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "claimed").otherwise("ambiguous").alias("state"))


#: More alternatives than this of one declaration are refused.
MAX_ALTERNATIVES = 32


def alternatives(members: DataFrame) -> DataFrame:
    """Members (file, owner, kind, name, id, start, end) that stand two or more times: the group, alternatives, state.

    State is sound, overlapping (two spans of a group meet) or too_many. Spans are compared with the furthest end
    before them, so no pairs are made.
    """
    key = ["file", "owner", "kind", "name"]
    w = Window.partitionBy(*key).orderBy("start", "end", "id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = members.withColumn("__meets", F.col("start") < before).groupBy(*key).agg(F.count(F.lit(1)).alias("alternatives"), F.bool_or(F.coalesce("__meets", F.lit(False))).alias("__meet"))
    state = F.when(F.col("alternatives") > MAX_ALTERNATIVES, "too_many").when(F.col("__meet"), "overlapping").otherwise("sound")
    return g.where("alternatives >= 2").select(*key, "alternatives", state.alias("state"))


def move_signatures(signatures: DataFrame, alternatives_: DataFrame) -> DataFrame:
    """Signatures (id, subject_id) moved onto declaration alternatives (alternative_id, declaration_id): id, subject_id, state.

    A signature of a declaration without alternatives stays (kept); an alternative without signature is an error
    (missing, null id).
    """
    a = alternatives_.select("alternative_id", F.col("declaration_id").alias("__d"))
    rows = signatures.select("id", "subject_id").join(a, F.col("subject_id") == F.col("__d"), "full_outer")
    state = F.when(F.col("id").isNull(), "missing").when(F.col("alternative_id").isNull(), "kept").otherwise("moved")
    return rows.select("id", F.coalesce("alternative_id", "subject_id").alias("subject_id"), state.alias("state"))


def inherited_dependencies(dependencies: DataFrame, declared: DataFrame) -> DataFrame:
    """Dependencies (workspace, package, name) that inherit, against the workspace's own (workspace, name, id): REFERENCES_DECLARATION or a gap.

    Gives workspace, package, name, target, gap.
    """
    d = declared.groupBy("workspace", "name").agg(F.min("id").alias("target"))
    rows = dependencies.select("workspace", "package", "name").join(d, ["workspace", "name"], "left")
    return rows.select("workspace", "package", "name", "target", F.when(F.col("target").isNull(), "cargo.workspace_inheritance_not_materialized").alias("gap"))


def materialised_targets(targets: DataFrame, crates: DataFrame) -> DataFrame:
    """Cargo targets (workspace, package, kind, name, path) and the crate (workspace, root_path, id) that each builds: MATERIALIZES.

    A target's crate is the one whose root source is the target's path; a target without one has a null crate.
    """
    c = crates.select("workspace", F.col("root_path").alias("path"), F.col("id").alias("crate_id"))
    return targets.join(c, ["workspace", "path"], "left").select("workspace", "package", "kind", "name", "path", "crate_id")


def overlay_union(base: DataFrame, overlay: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Chunks with the arrays of an overlay's chunk of the same ``key`` merged in, sorted and each once; unique keys."""
    o = overlay.select(key, *[F.col(a).alias(f"__{a}") for a in arrays])
    none = F.array().cast("array<string>")
    merged = [F.array_sort(F.array_union(F.coalesce(F.col(a), none), F.coalesce(F.col(f"__{a}"), none))).alias(a) for a in arrays]
    return base.join(o, key, "left").select(*[c for c in base.columns if c not in arrays], *merged)
