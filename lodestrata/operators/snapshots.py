"""What changed between consecutive full snapshots.

Rows shrink to fixed-width records: a 128-bit key hash, the rank of their snapshot and a row hash. They are
hash-partitioned by key, so any one snapshot or group is spread over all partitions; each partition holds
them as numpy arrays, sorts once, and finds each record's partner in the snapshot before and after with
``searchsorted``. Only the keys that differ fetch their full values in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import id16
from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import BROADCAST_LIMIT_BYTES, broadcast_if_small, materialize, partitions_for, stored_bytes

#: Compact rows of one task: 40 bytes each, a few times that while sorting.
ROWS_PER_TASK = 2_000_000

KINDS = ("added", "deleted", "modified")


def plain_path(col: Column) -> Column:
    """A path with `/` once between names, without outer blanks or leading ``./``; case kept."""
    slashed = F.regexp_replace(F.btrim(col, F.lit(" \t\r\n\f\v")), r"[\\/]+", "/")
    return F.regexp_replace(slashed, r"^(\./)+", "")


def _codes(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Dense codes of the 128-bit keys."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), dtype=np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    code = np.empty(len(a), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return code


def diff_arrays(k1: np.ndarray, k2: np.ndarray, rank: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of differing records, the rank of the later snapshot, and the kind (index into KINDS).

    ``rank`` numbers the snapshots of a group without gaps, and keys differ between groups; ``first`` and ``last``
    tell whether the group has none before or after. Several records of one key in a snapshot are taken
    together: the key is modified where the set of its values is another. Records are distinct.
    """
    if not len(k1):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    code = _codes(k1, k2)
    width = int(code.max()) + 1
    base = int(rank.min())
    spot = (rank - base) * width + code
    order = np.argsort(spot, kind="stable")
    first_of = np.ones(len(spot), dtype=bool)
    first_of[1:] = spot[order][1:] != spot[order][:-1]
    starts = np.flatnonzero(first_of)
    pick = order[starts]
    spot = spot[pick]
    # the hash of a set of values: the sum of their mixed hashes, whatever their order
    mixed = row[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)

    def partner(shift: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(spot, spot + shift * width), len(spot) - 1)
        return at, spot[at] == spot + shift * width

    at, there = partner(-1)
    later = ~first[pick]
    added = later & ~there
    changed = later & there & (h != h[at])
    _, kept = partner(1)
    gone = ~last[pick] & ~kept
    idx = np.concatenate([pick[added], pick[gone], pick[changed]])
    gen = np.concatenate([rank[pick[added]], rank[pick[gone]] + 1, rank[pick[changed]]])
    kind = np.concatenate([np.full(int(m.sum()), k) for k, m in enumerate((added, gone, changed))])
    return idx, gen, kind


def _diff_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    col = {c: t.column(c).to_numpy() for c in ("k1", "k2", "rank", "h")}
    flags = {c: t.column(c).to_numpy().astype(bool) for c in ("first", "last")}
    idx, gen, kind = diff_arrays(col["k1"], col["k2"], col["rank"], flags["first"], flags["last"], col["h"])
    yield pa.RecordBatch.from_arrays([pa.array(col["k1"][idx]), pa.array(col["k2"][idx]), pa.array(gen), pa.array(kind.astype("int32"))], names=["k1", "k2", "rank", "kind"])


def snapshot_changes(rows: DataFrame, group: str, version: str, delivered: str, key: str, value: Column) -> DataFrame:
    """``group``, ``version`` (of the later snapshot), ``key``, ``change_kind`` for every difference.

    ``rows`` are the records of full snapshots: of several deliveries of one version the one with the
    greatest ``delivered`` counts, as a whole; consecutive means the next version number the group has. The
    first version has no changes. ``value`` is compared null-safely; of a key with several values in one snapshot
    the set of them is. Rows without group, version, key or
    delivery time are ignored. Empty input gives an empty result; other columns are never read.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(group).alias("g"), F.col(version).alias("v"), F.col(delivered).alias("at"), F.col(key).alias("k"), value.alias("val")).where(
        "g IS NOT NULL AND v IS NOT NULL AND at IS NOT NULL AND k IS NOT NULL"
    )
    # one row per snapshot; the key hash holds the group, so a rank inside the group is enough
    w = Window.partitionBy("g").orderBy("v")
    latest = base.groupBy("g", "v").agg(F.max("at").alias("at"))
    place = F.row_number().over(w)
    snapshots = materialize(
        latest.select("g", "v", "at", place.cast("long").alias("rank"), F.lead("v").over(w).isNull().alias("last"), (place == 1).alias("first")), "snapshots"
    )
    key_hash = [F.xxhash64("g", "k").alias("k1"), F.xxhash64(F.lit("second"), "k", "g").alias("k2")]
    one = id16(F.concat_ws("\x1f", "g", F.col("v").cast("string"), F.col("at").cast("string")))
    if stored_bytes(snapshots) * 4 <= BROADCAST_LIMIT_BYTES:
        ranked = base.join(F.broadcast(snapshots), ["g", "v", "at"])
    else:  # a snapshot may hold a third of all rows
        keyed = base.withColumn("__s", one)
        ranked = skew_join(keyed, snapshots.select(one.alias("__s"), "rank", "first", "last"), "__s", "inner", hot_keys(keyed, F.col("__s")), F.col("k"))
    compact = (
        ranked.select(*key_hash, "rank", "first", "last", F.when(F.col("val").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("val")).alias("h"))
        .distinct()
    )
    n = partitions_for(rows.count(), ROWS_PER_TASK, spark)
    found = materialize(compact.repartition(n, "k1").mapInArrow(_diff_partition, "k1 long, k2 long, rank long, kind int"), "diffs")
    # full values only for the keys that differ
    wanted = found.select("k1", "k2").distinct()
    keys = base.select(*key_hash, "g", "k")
    if stored_bytes(found) * 4 <= BROADCAST_LIMIT_BYTES:
        names = keys.join(F.broadcast(wanted), ["k1", "k2"], "left_semi").distinct()
    else:  # each key once before the shuffle, however often it is repeated
        names = keys.distinct().join(wanted, ["k1", "k2"], "left_semi")
    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    at = broadcast_if_small(snapshots.select("g", "rank", "v"), of=snapshots)
    return (
        found.join(names, ["k1", "k2"])
        .join(at, ["g", "rank"])
        .select(F.col("g").alias(group), F.col("v").alias(version), F.col("k").alias(key), kinds.alias("change_kind"))
    )
