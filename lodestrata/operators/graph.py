"""Operators on a typed property graph: entities (id, kind, ...) and relationships (id, kind, source, target).

All functions take and return DataFrames. Fixpoints write each round to the shared folder; only row counts
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import materialize

#: Rounds of a fixpoint that doubles its reach: more than any table needs. Running out of them is an error.
MAX_ROUNDS = 62
#: Levels of the flow graph of one callable that reaching definitions may go through.
MAX_LEVELS = 10_000
#: Single steps of the evidence closure before it doubles: most chains of evidence are this short.
SINGLE_STEPS = 4


class Unfinished(RuntimeError):
    """A fixpoint used up its rounds: its result would be incomplete, so there is none."""


def incident(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The edges that touch a seed: seed, relationship_id, kind, direction (out, in), other. ``seeds`` has id, unique.

    A self-loop comes out in both directions.
    """
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    both = e.select(F.col("source").alias("seed"), F.col("id").alias("relationship_id"), "kind", F.lit("out").alias("direction"), F.col("target").alias("other")).unionByName(
        e.select(F.col("target").alias("seed"), F.col("id").alias("relationship_id"), "kind", F.lit("in").alias("direction"), F.col("source").alias("other"))
    )
    return both.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")


def two_step(edges: DataFrame, seeds: DataFrame, first: str, second: str) -> DataFrame:
    """seed, via, reached: one edge of kind ``first`` out of the seed, then one of kind ``second``."""
    a = edges.where(F.col("kind") == first).select(F.col("source").alias("seed"), F.col("target").alias("via"))
    b = edges.where(F.col("kind") == second).select(F.col("source").alias("via"), F.col("target").alias("reached"))
    return a.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").join(b, "via").select("seed", "via", "reached").distinct()


def bounded_traversal(edges: DataFrame, seeds: DataFrame, depth: int = 2, subjects: int = 256) -> DataFrame:
    """Undirected breadth-first traversal of each seed: seed, id, hops, truncated.

    A hop adds the nodes not yet visited, nearest first and by id, until a seed has ``subjects`` nodes; then
    its rows are marked truncated. The cap is the operator's feature: an answer for a viewer.
    """
    flat = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("id"), F.lit(0).alias("hops"))
    front, cut = seen, None
    for h in range(1, depth + 1):
        step = front.select("seed", F.col("id").alias("a"))
        new = skew_join(step, flat, "a", "inner", hot_keys(step, F.col("a")), F.col("seed")).select("seed", F.col("b").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        have = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("have"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("id"))
        # at most `subjects` of a seed can still fit: the rank filter lets Spark cut each task's rows first
        ranked = new.withColumn("place", place).where(F.col("place") <= subjects).join(have, "seed")
        over = ranked.where(F.col("have") + F.col("place") > subjects).select("seed").distinct()
        cut = over if cut is None else cut.unionByName(over)
        front = materialize(ranked.where(F.col("have") + F.col("place") <= subjects).select("seed", "id", F.lit(h).alias("hops")), "hop")
        seen = seen.unionByName(front)
    marked = cut.distinct().withColumn("__cut", F.lit(True))
    return seen.join(marked, "seed", "left").select("seed", "id", "hops", F.coalesce("__cut", F.lit(False)).alias("truncated"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (source, target) pairs joined by a path of at least one edge; a node reaches itself only by a cycle.

    Semi-naive with doubling: a pair whose shortest path is longer than 2^k starts with one of exactly 2^k
    edges, which the last round found, so each round joins only the last round's pairs with all pairs and the
    rounds are the logarithm of the longest shortest path. New pairs are written to the shared folder. Null
    ends are no edges; repeated edges count once. Rounds that run out are an error, never a cut result.
    """
    found = materialize(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "edges")
    delta, new, rounds = found, found.count(), 0
    while new:
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise Unfinished(f"closure: {new} new pairs after {MAX_ROUNDS} rounds")
        step = found.select(F.col("source").alias("mid"), F.col("target").alias("next"))
        hot = hot_keys(delta, F.col("target"), new)
        longer = skew_join(delta.withColumnRenamed("target", "mid"), step, "mid", "inner", hot, F.col("source")).select("source", F.col("next").alias("target")).distinct()
        delta = materialize(longer.join(found, ["source", "target"], "left_anti"), "delta")
        new = delta.count()
        found = found.unionByName(delta)
    return found


def ancestors(closure: DataFrame) -> DataFrame:
    """node, ancestor: the closure read backwards."""
    return closure.select(F.col("target").alias("node"), F.col("source").alias("ancestor"))


def path_slice(edges: DataFrame, closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (s, t): the edges on some path from s to t: s, t, source, target. ``closure`` is that of ``edges``.

    An edge is on one if s is or reaches its source and its target is or reaches t. A pair's candidates are the
    edges below s or those above t, whichever are fewer; each is looked up once from the other end. So a pair
    of a root and a leaf costs the leaf's ancestors, not all that the root reaches.
    """
    e = edges.select("source", "target").distinct()
    ends = materialize(pairs.where("s IS NOT NULL AND t IS NOT NULL").select("s", "t").distinct(), "pairs")

    def reach(end: str, near: str, far: str) -> DataFrame:
        own = ends.select(end).distinct()
        others = closure.select(F.col(near).alias(end), F.col(far).alias("x")).join(own, end, "left_semi")
        return materialize(others.unionByName(own.select(end, F.col(end).alias("x"))).distinct(), "reach")

    down, up = reach("s", "source", "target"), reach("t", "target", "source")
    hot_down, hot_up = hot_keys(down, F.col("x")), hot_keys(up, F.col("x"))
    # inner joins: a pair without an edge below s or above t has no path
    below = skew_join(down, e.groupBy(F.col("source").alias("x")).agg(F.count(F.lit(1)).alias("n")), "x", "inner", hot_down, F.col("s")).groupBy("s").agg(F.sum("n").alias("below"))
    above = skew_join(up, e.groupBy(F.col("target").alias("x")).agg(F.count(F.lit(1)).alias("n")), "x", "inner", hot_up, F.col("t")).groupBy("t").agg(F.sum("n").alias("above"))
    sides = materialize(ends.join(below, "s").join(above, "t").select("s", "t", (F.col("below") < F.col("above")).alias("from_s")), "sides")

    def sliced(mine: DataFrame, end: str, other: str, reached: DataFrame, hot: list[int], at: str, check: DataFrame, to: str) -> DataFrame:
        wanted = reached.join(mine.select(end).distinct(), end, "left_semi").withColumnRenamed("x", at)
        candidates = skew_join(wanted, e, at, "inner", hot, F.col(end))
        per_pair = skew_join(mine.select("s", "t"), candidates, end, "inner", hot_keys(mine, F.col(end)), F.col(other))
        return per_pair.join(check.withColumnRenamed("x", to), [other, to], "left_semi").select("s", "t", "source", "target")

    from_t = sliced(sides.where("NOT from_s"), "t", "s", up, hot_up, "target", down, "source")
    return from_t.unionByName(sliced(sides.where("from_s"), "s", "t", down, hot_down, "source", up, "target"))


def degrees(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """id with in_ and out_ counts per kind."""
    rows = edges.select(F.col("source").alias("id"), F.concat(F.lit("out_"), F.lower("kind")).alias("k")).unionByName(edges.select(F.col("target").alias("id"), F.concat(F.lit("in_"), F.lower("kind")).alias("k")))
    names = [f"{d}_{k.lower()}" for k in kinds for d in ("in", "out")]
    return rows.groupBy("id").agg(*[F.count(F.when(F.col("k") == n, 1)).alias(n) for n in names])


def evidence_closure(start: DataFrame, refs: DataFrame) -> DataFrame:
    """Ids reached from ``start`` (id) over ``refs`` (id, evidence_id), the start included: id.

    The first SINGLE_STEPS steps follow the references one by one. What is left is doubled: with all ids of
    less than n steps and the pairs of exactly n steps at hand, one join gives all ids of less than 2n. A round
    without a new id ends it, since every distance has one. Null ends are no references.
    """
    refs = materialize(refs.where("id IS NOT NULL AND evidence_id IS NOT NULL").select("id", "evidence_id").distinct(), "refs")
    found = materialize(start.where("id IS NOT NULL").select("id").distinct(), "ev")
    front = found
    for _ in range(SINGLE_STEPS):
        new = front.join(refs, "id").select(F.col("evidence_id").alias("id")).distinct().join(found, "id", "left_anti")
        front = materialize(new, "ev")
        if not front.head(1):
            return found
        found = found.unionByName(front)
    # beyond: from the last step's ids, over references to ids not yet found
    found = materialize(found, "ev")
    open_refs = refs.join(found.withColumnRenamed("id", "evidence_id"), "evidence_id", "left_anti").join(
        found.join(front, "id", "left_anti"), "id", "left_anti"
    )
    jump = materialize(open_refs.select("id", "evidence_id"), "jump")
    for _ in range(MAX_ROUNDS):
        reached = front.join(jump, "id").select(F.col("evidence_id").alias("id")).distinct().join(front, "id", "left_anti")
        new = materialize(reached, "ev")
        if not new.head(1):
            return found
        front, found = front.unionByName(new), found.unionByName(new)
        twice = jump.withColumnRenamed("evidence_id", "mid").join(jump.withColumnRenamed("id", "mid"), "mid").select("id", "evidence_id").distinct()
        jump = materialize(twice, "jump")
    raise Unfinished(f"evidence closure: new ids after {MAX_ROUNDS} rounds")


def reaching_definitions(ops: DataFrame, flow: DataFrame) -> DataFrame:
    """Which definitions reach each read: callable, read_id, definition_id, mode (must, may).

    ``ops``: callable, block (long), ordinal, op_id, binding, kind (write, read). ``flow``: callable, source, target
    blocks, acyclic in block order. A binding's definitions at a block's start are the union of its
    predecessors' (may), and those on every one of them (must). A read of a binding without definition gives
    no row. Levels of the flow graph are solved one after another over all callables together; a cycle in it,
    or more than MAX_LEVELS of them, is an error.
    """
    w = Window.partitionBy("callable", "block", "binding").orderBy("ordinal", "op_id")
    local = ops.select("callable", "block", "ordinal", "op_id", "binding", "kind", F.last(F.when(F.col("kind") == "write", F.col("op_id")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("local_def"))
    inside = local.where("kind = 'read' AND local_def IS NOT NULL").select("callable", F.col("op_id").alias("read_id"), F.col("local_def").alias("definition_id"), F.lit("must").alias("mode"))
    open_reads = local.where("kind = 'read' AND local_def IS NULL").select("callable", "block", "binding", F.col("op_id").alias("read_id"))
    last_def = ops.where("kind = 'write'").groupBy("callable", "block", "binding").agg(F.max_by("op_id", F.struct("ordinal", "op_id")).alias("def"))
    blocks = materialize(
        ops.select("callable", "block").unionByName(flow.select("callable", F.col("source").alias("block"))).unionByName(flow.select("callable", F.col("target").alias("block"))).distinct(), "blocks"
    )
    edges = materialize(flow.select("callable", "source", "target").distinct(), "flow")
    preds = edges.groupBy("callable", F.col("target").alias("block")).agg(F.count(F.lit(1)).alias("preds"))
    level = blocks.join(preds, ["callable", "block"], "left").where("preds IS NULL").select("callable", "block")
    gen = materialize(last_def, "gen")
    # out-state of the blocks solved so far: callable, block, binding, may, must
    none = F.array().cast("array<string>")
    state = None
    arrived = None
    done = None
    levels = 0
    while level.head(1):
        levels += 1
        if levels > MAX_LEVELS:
            raise Unfinished(f"reaching definitions: blocks left after {MAX_LEVELS} levels")
        if state is None:
            into = gen.select("callable", "block", "binding", none.alias("may"), none.alias("must")).limit(0)
        else:
            coming = edges.join(level.withColumnRenamed("block", "target"), ["callable", "target"], "left_semi")
            joined = coming.join(state.withColumnRenamed("block", "source"), ["callable", "source"]).groupBy("callable", F.col("target").alias("block"), "binding").agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("may")))).alias("may"), F.flatten(F.collect_list("must")).alias("all_must"), F.count(F.lit(1)).alias("n")
            )
            into = joined.join(preds, ["callable", "block"]).select(
                "callable", "block", "binding", "may",
                F.filter("may", lambda d: (F.size(F.filter(F.col("all_must"), lambda x: x == d)) == F.col("preds"))).alias("must"),
            )
        into = materialize(into, "in")
        arrived = into if arrived is None else arrived.unionByName(into)
        own = gen.join(level, ["callable", "block"], "left_semi").select("callable", "block", "binding", F.array("def").alias("may"), F.array("def").alias("must"))
        out = materialize(into.join(own, ["callable", "block", "binding"], "left_anti").unionByName(own), "out")
        state = out if state is None else state.unionByName(out)
        done = level if done is None else done.unionByName(level)
        ready = edges.join(done.withColumnRenamed("block", "source"), ["callable", "source"], "left_semi").groupBy("callable", F.col("target").alias("block")).agg(F.count(F.lit(1)).alias("have"))
        level = materialize(ready.join(preds, ["callable", "block"]).where("have = preds").select("callable", "block").join(done, ["callable", "block"], "left_anti"), "level")
    left = blocks if done is None else blocks.join(done, ["callable", "block"], "left_anti")
    if left.head(1):
        raise Unfinished("reaching definitions: the flow has a cycle")
    if arrived is None:  # no blocks at all
        return inside
    reach = open_reads.join(arrived, ["callable", "block", "binding"])
    outside = reach.select("callable", "read_id", F.explode("may").alias("definition_id"), "must").select(
        "callable", "read_id", "definition_id", F.when(F.array_contains("must", F.col("definition_id")), "must").otherwise("may").alias("mode")
    )
    return inside.unionByName(outside)


def navigation_roles(rows: DataFrame) -> DataFrame:
    """``rows`` (id, role): each id with its distinct roles, sorted, as one text."""
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def containment(parents: DataFrame, rule: str, edge_id: Column) -> DataFrame:
    """Rule-derived CONTAINS edges from (parent, child, parent_claim, child_claim), with their input claims."""
    return parents.where("parent IS NOT NULL").select(
        edge_id.alias("id"), F.lit("CONTAINS").alias("kind"), F.col("parent").alias("source"), F.col("child").alias("target"), F.lit(rule).alias("rule_version"),
        F.array_join(F.array_sort(F.array_compact(F.array("parent_claim", "child_claim"))), ",").alias("input_claim_ids"),
    )


def read_derivations(reaching: DataFrame, places: DataFrame, flow: DataFrame, closure: DataFrame) -> DataFrame:
    """Why a read sees its definitions: callable, read_id, start_block, definitions, blocks.

    ``reaching`` (callable, read_id, definition_id), ``places`` (callable, op_id, block), ``flow`` and ``closure``
    (callable, source, target blocks). The slice starts at the only defining block, else at the latest block
    from which all of them are reached (or that is one itself), else at the read's own; it holds the blocks
    on any path from there to the read.
    """
    at = places.select("callable", F.col("op_id").alias("definition_id"), F.col("block").alias("def_block"))
    here = places.select("callable", F.col("op_id").alias("read_id"), F.col("block").alias("read_block"))
    defs = reaching.select("callable", "read_id", "definition_id").distinct().join(at, ["callable", "definition_id"])
    each = defs.select("callable", "read_id", "def_block").distinct()
    n = each.groupBy("callable", "read_id").agg(F.count(F.lit(1)).alias("n"), F.min("def_block").alias("only"))
    above = closure.select("callable", F.col("source").alias("top"), F.col("target").alias("def_block"))
    own = each.select("callable", F.col("def_block").alias("top"), "def_block").distinct()
    shared = each.join(above.unionByName(own).distinct(), ["callable", "def_block"]).groupBy("callable", "read_id", "top").agg(F.count(F.lit(1)).alias("k")).join(n, ["callable", "read_id"]).where("k = n")
    latest = shared.groupBy("callable", "read_id").agg(F.max("top").alias("common"))
    start = n.join(latest, ["callable", "read_id"], "left").join(here, ["callable", "read_id"]).select("callable", "read_id", "read_block", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("common", "read_block")).alias("start_block"))
    self_ = start.select("callable", F.explode(F.array("start_block", "read_block")).alias("b")).distinct()
    reach = closure.select("callable", "source", "target").unionByName(self_.select("callable", F.col("b").alias("source"), F.col("b").alias("target"))).distinct()
    down = reach.select("callable", F.col("source").alias("start_block"), F.col("target").alias("b"))
    up = reach.select("callable", F.col("target").alias("read_block"), F.col("source").alias("b"))
    inside = start.join(down, ["callable", "start_block"]).join(up, ["callable", "read_block", "b"]).groupBy("callable", "read_id", "start_block").agg(F.array_sort(F.collect_set("b")).alias("blocks"))
    listed = defs.groupBy("callable", "read_id").agg(F.array_sort(F.collect_set("definition_id")).alias("definitions"))
    return start.select("callable", "read_id", "start_block").join(listed, ["callable", "read_id"]).join(inside, ["callable", "read_id", "start_block"], "left")
