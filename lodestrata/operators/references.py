"""References to records that do not exist.

Composite reference keys are grouped by their null mask; each mask is joined to the targets on the
columns that are not null, under the declared match semantics of SQL:

* ``simple``  - a key with any null is no reference.
* ``partial`` - the non-null columns must agree with some target; an all-null key is no reference.
* ``full``    - an all-null key is no reference, a partly null one is ``malformed``, else all must agree.

A reference comes out with status ``missing`` (the anti-join: no target), ``deleted`` (its target is
deleted), ``late`` (its target was first seen after the reference) or ``malformed``. References without
fault do not come out.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import clean_id, id16, micros
from lodestrata.operators.skew import skew_join

#: Stands for a recorded_at that is null: before any other.
NO_TIME = -(2**62)


def target_states(rows: DataFrame, keys: list[str], recorded: str = "recorded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """One row per target key: when it was first seen, and whether its counting row is deleted.

    The counting row is the one with the greatest ``recorded``; of several at that instant a deleted one
    counts. Only fixed-width buffers are aggregated, so the map side combines before the shuffle.
    """
    t = F.coalesce(micros(recorded), F.lit(NO_TIME))
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    return (
        rows.select(*keys, t.alias("__t"), gone.alias("__d"))
        .groupBy(*keys)
        .agg(F.min("__t").alias("first_seen"), F.max("__t").alias("__last"), F.max(F.when(F.col("__d"), F.col("__t"))).alias("__gone"))
        .select(*keys, "first_seen", F.coalesce(F.col("__gone") == F.col("__last"), F.lit(False)).alias("target_deleted"))
    )


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str], ref_time: str, match: str = "simple", hot: list[int] | None = None, spread: Column | None = None) -> DataFrame:
    """The faulty references of ``refs`` with a ``status`` column.

    ``refs`` has the ``keys`` (null where a part is absent), ``ref_time`` in microseconds and any payload.
    ``targets`` has the ``keys``, ``first_seen`` and ``target_deleted``, one row per key (see
    :func:`target_states`); rows with a null key part are ignored. An empty ``targets`` makes every
    reference missing; an empty ``refs`` gives an empty result. Payload names may not start with ``__``.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    if hot and spread is None:
        raise ValueError("hot keys need a column to spread them by")
    payload = refs.columns
    sound = targets.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        on = [k for k, there in zip(keys, mask) if there]
        if not on or (match == "simple" and len(on) < len(keys)):
            continue
        group = refs
        for k, there in zip(keys, mask):
            group = group.where(F.col(k).isNotNull() if there else F.col(k).isNull())
        if match == "full" and len(on) < len(keys):
            parts.append(group.select(*payload, F.lit("malformed").alias("status")))
            continue
        join_key = id16(F.concat_ws("\x1f", *on)) if len(on) > 1 else id16(F.col(on[0]).cast("string"))
        right = sound.select(join_key.alias("__key"), F.col("first_seen").alias("__first"), F.col("target_deleted").alias("__gone"))
        if len(on) < len(keys):
            right = right.groupBy("__key").agg(F.min("__first").alias("__first"), F.min("__gone").alias("__gone"))
        joined = skew_join(group.withColumn("__key", join_key), right, "__key", "left", hot or [], spread)
        status = (
            F.when(F.col("__gone").isNull(), "missing")
            .when(F.col("__gone"), "deleted")
            .when(F.col("__first") > F.coalesce(F.col(ref_time), F.lit(NO_TIME)), "late")
        )
        parts.append(joined.select(*payload, status.alias("status")).where("status IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counting_rows(rows: DataFrame, payload: list[str], recorded: str = "recorded_at") -> DataFrame:
    """Per clean id the row with the greatest ``recorded``; ties fall to the greatest ingested_at, then payload.

    Rows without an id are no records. Aggregated as one struct maximum: combined map-side, no window.
    """
    order = [c for c in (recorded, "ingested_at") if c in rows.columns]
    return (
        rows.select(clean_id("id").alias("record_id"), F.struct(*order, *[c for c in payload if c not in order]).alias("__r"))
        .where("record_id IS NOT NULL")
        .groupBy("record_id")
        .agg(F.max("__r").alias("__r"))
        .select("record_id", *[F.col(f"__r.{c}").alias(c) for c in dict.fromkeys([*order, *payload])])
    )
