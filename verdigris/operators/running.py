"""Running totals that stay parallel when one key holds a large share of all rows.

A plain window sends every row of a key to one task. Here each key is cut into ordered
slices; slice totals are pre-aggregated on the map side, prefix-summed over the (few)
slices, and added to a window that only ever sees one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this rank Spark would stop cutting keys before the shuffle.
def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums. ``slice_by`` must grow with the first order column."""
    sliced = df.withColumn("_slice", slice_by)
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(value).alias(f"_total_{name}") for name, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(key).alias(f"_key_{key}") for key in keys],
        F.col("_slice").alias("_key_slice"),
        *[
            F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select("*", *[F.sum(value).over(inside).alias(f"_local_{name}") for name, value in sums.items()])
    matched = F.col("_slice").eqNullSafe(F.col("_key_slice"))
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    joined = local.join(offsets, matched)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{name}") + F.col(f"_local_{name}")).alias(name) for name in sums],
    )


def time_slice(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Up to the session's window group limit, Spark cuts each key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; Spark keeps one row per key and task before the shuffle."""
    return first_n(df, keys, [F.desc(name) for name in order], 1, "_newest").drop("_newest")


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Oldest row per key, likewise."""
    return first_n(df, keys, [F.asc(name) for name in order], 1, "_oldest").drop("_oldest")
