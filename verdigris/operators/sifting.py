"""Rows that can't match some keys are told by a map of fixed size, so that they need not be shuffled to a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the map by which ``sift`` lets rows through: with 64 in a row, at most 2**18 rows are ever sent to the tasks.
SIFT_BITS = 1 << 24


def sift(df: DataFrame, keys: DataFrame, columns: list[str], keep: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``columns`` may equal a row of ``keys``; with ``keep`` false, the others.

    A map of fixed size, one bit per hash value: no equal row is ever missed, a few others come through (all, where the keys
    are so many that every bit is set), so a join must follow. It only saves shuffling rows that can't match.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(SIFT_BITS))
    word, bit = fresh(df, "sift_word"), fresh(df, "sift_bits")
    bits = (
        keys.select(F.shiftright(place, 6).alias(word), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}), 64) as int))").alias(bit))
        .groupBy(word).agg(F.bit_or(bit).alias(bit))
    )
    held = df.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(bits), word, "left")
    there = F.coalesce(F.getbit(F.col(bit), F.pmod(F.xxhash64(*columns), F.lit(64)).cast("int")) == 1, F.lit(False))
    return held.where(there if keep else ~there).drop(word, bit)


#: Types whose equal values have equal hashes.
PLAIN = frozenset(("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp"))


def without(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without the rows whose ``columns`` equal a row of ``keys``; only rows that ``sift`` can't tell are shuffled.

    ``df`` and ``keys`` are read twice and more, so both should be tables. Columns of different types are joined as they are.
    """
    kinds = [(dict(df.dtypes)[name], dict(keys.dtypes)[name]) for name in columns]
    if any(own != other or own not in PLAIN for own, other in kinds):
        return df.join(keys.select(columns), columns, "left_anti").select(*(f"`{name}`" for name in df.columns))
    maybe = sift(df, keys, columns).join(keys.select(columns), columns, "left_anti")
    return sift(df, keys, columns, keep=False).unionByName(maybe.select(*(f"`{name}`" for name in df.columns)))
