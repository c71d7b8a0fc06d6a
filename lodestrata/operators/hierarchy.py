"""Parent-child rows to full hierarchies by pointer doubling.

Each round joins every open node's ancestor pointer with that ancestor's own pointer, so the jump doubles
and a node of depth d is resolved after about log2(d) rounds. Nodes below 2^k are resolved after round k; a
round that resolves none therefore proves that the rest hang on cycles. For those, pointers are doubled
until the set they point at no longer shrinks: that set is exactly the nodes on cycles, the others lead
into one.

Node ids travel as 16-byte keys; every round's table is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import id16
from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import BROADCAST_LIMIT_BYTES, materialize, release, stored_bytes

#: Rounds after which a chain would be longer than any table: a guard, never reached.
MAX_ROUNDS = 62


def resolve(nodes: DataFrame, with_path: bool = False, label: str | None = None) -> DataFrame:
    """``nodes``: id, parent (strings, null for none), unique by id. Gives one row per id.

    Columns: id, root (id, null on or into a cycle), depth (0 root, -1 on a cycle, -2 leading into one) and,
    with ``with_path``, path: the array of ``label`` values (ids unless given) from the root to the node
    (null where there is no root). A parent that is not among the ids makes its child a root. Ids that are
    null are dropped. An empty table gives an empty result. A node that is its own parent is on a cycle.
    """
    spark = nodes.sparkSession
    seg = F.col(label or "id").cast("string")
    base = materialize(
        nodes.where("id IS NOT NULL").select("id", id16(F.col("id")).alias("n"), id16(F.col("parent")).alias("p"), *([F.coalesce(seg, F.col("id")).alias("seg")] if with_path else [])), "forest"
    )
    size = base.count()
    hot = hot_keys(base, F.col("p"), size)
    known = base.select(F.col("n").alias("p"), F.lit(True).alias("known"))
    start = skew_join(base.drop("id"), known, "p", "left", hot, F.col("n"))
    has = F.col("known").isNotNull()
    first = [F.col("n"), F.when(has, F.col("p")).otherwise(F.col("n")).alias("a"), F.when(has, 1).otherwise(0).cast("int").alias("d"), (~has).alias("done")]
    # segs: names from just below the pointer (or from the root itself) down to the node
    state = materialize(start.select(*first, *([F.array("seg").alias("segs")] if with_path else [])), "ptr")
    closed = state.where("done")
    active = state.where("NOT done")
    open_rows = active.count()
    resolved = [closed]
    every = state
    for _ in range(MAX_ROUNDS):
        if not open_rows:
            break
        hot = hot_keys(active, F.col("a"), open_rows)
        up = every.select(F.col("n").alias("a"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.col("done").alias("done2"), *([F.col("segs").alias("segs2")] if with_path else []))
        # only the nodes that some pointer names are joined: where these are few, the others are never shuffled
        named = materialize(active.select("a").distinct(), "named")
        if stored_bytes(named) * 2 <= BROADCAST_LIMIT_BYTES:
            up = up.join(F.broadcast(named), "a", "left_semi")
        step = skew_join(active.drop("done"), up, "a", "inner", hot, F.col("n")).select(
            "n", F.col("a2").alias("a"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"), *([F.concat("segs2", "segs").alias("segs")] if with_path else [])
        )
        new = materialize(step, "ptr")
        release(named)
        resolved.append(new.where("done"))
        active = new.where("NOT done")
        left = active.count()
        every = active.unionByName(resolved[0])
        for r in resolved[1:]:
            every = every.unionByName(r)
        if left == open_rows:
            break
        open_rows = left
    cyclic = None
    if open_rows:
        # only cycles and what leads into them: double until the image no longer shrinks
        ptr, image = active.select("n", "a"), -1
        for _ in range(MAX_ROUNDS):
            now = ptr.select("a").distinct().count()
            if now == image:
                break
            image = now
            hot = hot_keys(ptr, F.col("a"), open_rows)
            up = ptr.select(F.col("n").alias("a"), F.col("a").alias("a2"))
            last = ptr
            ptr = materialize(skew_join(ptr, up, "a", "inner", hot, F.col("n")).select("n", F.col("a2").alias("a")), "cyc")
            release(last)  # the first one is a view of the active pointers, which stay
        on = ptr.select(F.col("a").alias("n")).distinct().withColumn("on", F.lit(True))
        cyclic = ptr.select("n").join(on, "n", "left").select("n", F.lit(None).cast("binary").alias("a"), F.when(F.col("on"), -1).otherwise(-2).cast("int").alias("d"), *([F.lit(None).cast("array<string>").alias("segs")] if with_path else []))
    cols = ["n", "a", "d", *(["segs"] if with_path else [])]
    done = resolved[0].select(*cols)
    for r in resolved[1:]:
        done = done.unionByName(r.select(*cols))
    if cyclic is not None:
        done = done.unionByName(cyclic)
    names = base.select("n", "id")
    roots = resolved[0].select("n").join(names, "n").select(F.col("n").alias("a"), F.col("id").alias("root"))
    named = done.join(names, "n")
    out = skew_join(named, roots, "a", "left", hot_keys(done, F.col("a"), size), F.col("n"))
    return out.select("id", "root", F.col("d").alias("depth"), *([F.col("segs").alias("path")] if with_path else []))


def descendants(nodes: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance) pair of the resolved nodes; distance 0 is the node itself.

    The pairs are as many as the depths of all nodes together, not squares of group sizes.
    """
    paths = resolve(nodes, with_path=True).where("depth >= 0")
    return paths.select(F.posexplode("path").alias("pos", "ancestor"), F.col("id").alias("descendant"), F.col("depth")).select(
        "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance")
    )
