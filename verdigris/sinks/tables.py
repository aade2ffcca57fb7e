"""Writing review tables: partitioned files, upserts, partition replacement, versioned table sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.running import latest

MAX_RECORDS_PER_FILE = 5_000_000
COMMITTED = "_committed"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, one directory per partition value.

    The rebalance hint gives every value few files, yet splits a value that holds a large share of the rows.
    """
    balanced = df.hint("rebalance", *partition_by) if partition_by else df
    writer = balanced.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows and changes, newest per key."""
    return latest(current.unionByName(changes), keys, order)


def upsert_owned(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], owner: str = "owner_id") -> DataFrame:
    """Like ``upsert_latest``; a change to a row of another owner is refused."""
    owners = current.select(*keys, F.col(owner).alias("_owner")).distinct()
    allowed = changes.join(owners, keys, "left").where(F.col("_owner").isNull() | (F.col("_owner") == F.col(owner))).drop("_owner")
    return upsert_latest(current, allowed, keys, order)


def replace_partition(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; others stay as they are."""
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_version(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write a set of tables as one version. The marker comes last, so a failed job leaves the old version current."""
    for name, df in tables.items():
        write_table(df, f"{root}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(version).cast("int").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/{COMMITTED}")


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest complete version."""
    return spark.read.parquet(f"{root}/{COMMITTED}").agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, root: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    number = current_version(spark, root) if version is None else version
    return {name: spark.read.parquet(f"{root}/version={number}/{name}") for name in names}
