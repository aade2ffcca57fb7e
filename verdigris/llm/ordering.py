"""Row numbers per key that stay parallel when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import fresh
from verdigris.session import settle


def tied(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for every row, so that equal rows can be told apart and dealt to several tasks.

    Settle the result before it is used twice: the numbers depend on how the rows lie.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... within each key, in the given order; a null key is a key like any other.

    Rows are dealt by ranges of key and order, so a key of very many rows spreads over many tasks; each range is numbered
    for itself and shifted by the rows that the key has in earlier ranges, of which there are no more than tasks.
    """
    part, before, local = fresh(df, "range_part"), fresh(df, "range_before"), fresh(df, "range_local")
    placed = settle(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    left = placed.withColumn(local, F.row_number().over(inside) - 1).alias("l")
    same = F.col(f"l.{part}") == F.col(f"r.{part}")
    for key in keys:
        same = same & F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    kept = [F.col(f"l.`{column}`") for column in df.columns]
    return left.join(shifts.alias("r"), same).select(*kept, (F.col(f"l.{local}") + F.col(f"r.{before}")).alias(name))
