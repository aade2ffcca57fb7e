"""Set operations on review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.running import running_totals


def shared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of the left side that the right side lacks."""
    return left.select(*keys).subtract(right.select(*keys))


def sharing_hash(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the left side with at least one hash in common with the right, by an exploded semi join."""
    return left.join(right.select(*key).distinct(), key, "left_semi")


def arrays_share(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, slice_size: int = 65_536) -> DataFrame:
    """Each value once per key, numbered by where it first occurred. ``order`` is a number, unique per row.

    A key with very many values is numbered in slices of ``order``.
    """
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    numbered = running_totals(first, keys, [F.col("_first")], F.floor(F.col("_first") / slice_size), {"position": F.lit(1)})
    return numbered.drop("_first")


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions at once: rows of one side only, with the side that has them."""
    tag = lambda df, here: df.select(*keys, F.lit(here == "left").alias("_l"), F.lit(here == "right").alias("_r"))
    both = tag(left, "left").unionByName(tag(right, "right")).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.where(F.col("_l") != F.col("_r")).select(*keys, F.when(F.col("_l"), "left").otherwise("right").alias("only_in"))
