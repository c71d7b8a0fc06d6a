"""Global ordinals and exact quantiles without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import materialize, partitions_for

#: Rows of one task of a global sort.
ROWS_PER_TASK = 2_000_000
_LOW_33 = (1 << 33) - 1


def global_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``rows`` with their position (from 1) in the order of ``order``; ties fall as they come.

    Range-partitioned and sorted once; a position is the row's place in its partition plus the rows of the
    partitions before it. Only the partitions' row counts pass through one task.
    """
    n = partitions_for(rows.count(), ROWS_PER_TASK, rows.sparkSession)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__m"))
    t = materialize(placed, "sorted").withColumn("__p", F.shiftright("__m", 33))
    counts = t.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", before.alias("__b"))
    return t.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__m").bitwiseAND(F.lit(_LOW_33)) + F.col("__b") + 1).drop("__m", "__p", "__b")


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles of ``value`` per ``group``: group, percent, value. Null values do not count."""
    ranked = global_ordinal(rows.where(F.col(value).isNotNull()).select(group, value), [group, value], "__at")
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    wanted = sizes.select(F.col(group), F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"), "__n", "__first")
    rank = F.greatest(F.ceil(F.col("percent") * F.col("__n") / 100), F.lit(1))
    wanted = wanted.select("percent", (F.col("__first") + rank - 1).alias("__at"))
    return ranked.join(wanted, "__at").select(group, "percent", value)


def dense_groups(rows: DataFrame, group: str, ordinal: str, start: int = 0) -> DataFrame:
    """group, n, dense: whether a group's ordinals are start, start + 1, ... without gap or repeat; a null one never is."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(ordinal).alias("__k"), F.min(ordinal).alias("__a"), F.max(ordinal).alias("__b"), F.count_distinct(ordinal).alias("__d"))
    dense = (F.col("__k") == F.col("n")) & (F.col("__a") == start) & (F.col("__b") == F.col("n") + start - 1) & (F.col("__d") == F.col("n"))
    return g.select(group, "n", F.coalesce(dense, F.lit(False)).alias("dense"))
