"""Joins that hold when one key has a large share of the rows.

A frequency sketch (``approx_top_k``, merged map-side, one row per task reaches the driver) names the
keys that may hold more than ``1/SHARE`` of the rows. There are at most ``SHARE`` such keys, so the list
is bounded whatever the size of the data. Rows of those keys are spread over ``salts`` sub-keys; the other
side's few matching rows are repeated once per salt. Salting never changes a result, so the sketch may
err in either direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it may hold more than one part in SHARE of the rows.
SHARE = 64
#: Below this many rows a hot key is small enough for one task.
SMALL_ROWS = 200_000


def hot_keys(df: DataFrame, key: Column, rows: int | None = None, share: int = SHARE, small_rows: int = SMALL_ROWS) -> list[int]:
    """``xxhash64`` values of the keys that may hold over ``1/share`` of the non-null keys of ``df``.

    An empty table, or one of at most ``small_rows`` rows, has none; where the caller knows ``rows``, no job
    is run for such a one.
    """
    if rows is not None and rows <= small_rows:
        return []
    h = F.xxhash64(key).alias("h")
    top = df.where(key.isNotNull()).select(h).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {share}, {share * 64})").alias("top")
    ).first()
    if not top["n"] or top["n"] <= small_rows:
        return []
    return [r["item"] for r in top["top"] if r["count"] * share > top["n"]]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: list[int], spread: Column, salts: int = 16) -> DataFrame:
    """``left`` join ``right`` on the column ``key`` both have, with ``left``'s hot keys salted.

    ``how`` is inner, left, left_semi or left_anti. ``spread`` is a column of ``left`` that varies within a
    hot key. A null key joins nothing. The columns besides ``key`` must differ between the sides.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.xxhash64(F.col(key)).isin(hot)
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("__salt", F.explode(copies))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
