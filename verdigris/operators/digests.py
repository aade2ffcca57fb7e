"""Change-detection hashes over sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import UNIT_SEPARATOR

#: Hex digits of an item's hash that pick its leaf in a tree digest.
FANOUT_DIGITS = 3
#: Lanes of a digest and hex digits of an item's hash in each: four sums of 60-bit numbers.
LANES, LANE_DIGITS = 4, 15


def lane_sums(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """The state of a digest: per key the number of items (``items``) and the sums of their hashes (``lane0`` to ``lane3``).

    It adds: the states of two disjoint sets of items are summed column by column, and one that falls away is subtracted, so a
    stored state is kept up to date from the changes alone. Spark sums on the map side, so a key costs one row per task
    however many items it has.
    """
    hashed = df.select(*keys, F.sha2(item, 256).alias("_hash")).where(F.col("_hash").isNotNull())
    lanes = [
        F.sum(F.conv(F.substring("_hash", 1 + at * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(28,0)")).alias(f"lane{at}") for at in range(LANES)
    ]
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), *lanes)


def merged_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One state per key from several (negated columns take items away again); a key without items is gone."""
    sums = [F.sum(name).alias(name) for name in ("items", *(f"lane{at}" for at in range(LANES)))]
    return parts.groupBy(*keys).agg(*sums).where("items <> 0")


def finished(sums: DataFrame, keys: list[str], name: str = "digest") -> DataFrame:
    """The digests of states: hash of the number of items and of each lane modulo 2**60."""
    parts = [F.col("items").cast("string"), *(F.pmod(F.col(f"lane{at}"), F.lit(1 << 4 * LANE_DIGITS).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for at in range(LANES))]
    return sums.select(*keys, F.sha2(F.concat_ws(":", *parts), 256).alias(name))


def set_digest(df: DataFrame, keys: list[str], item: Column, name: str = "digest") -> DataFrame:
    """One hash per key over its items, independent of row order; an item that stands twice counts twice, null ones don't."""
    return finished(lane_sums(df, keys, item), keys, name)


def tree_digest(df: DataFrame, keys: list[str], item: Column, name: str = "digest") -> DataFrame:
    """One hash per key over the ordered texts of its items, independent of row order; equal items count, null ones don't.

    Unlike sums of hashes, every item enters a hash as text, in order: equal digests mean equal items, however they were made.
    A tree of two levels: equal items are counted on the map side, items are spread over 4096 leaves by their own hash, each leaf
    is hashed in item order, then the hashes of the leaves are hashed. A key with a third of all rows spreads over all tasks.
    """
    counted = df.select(*keys, item.alias("_item")).where(F.col("_item").isNotNull()).groupBy(*keys, "_item").count()
    entry = F.concat_ws(UNIT_SEPARATOR, "_item", F.col("count").cast("string"))
    ordered = lambda value: F.array_join(F.sort_array(F.collect_list(value)), UNIT_SEPARATOR)
    leaves = (
        counted.withColumn("_bucket", F.substring(F.sha2("_item", 256), 1, FANOUT_DIGITS))
        .groupBy(*keys, "_bucket")
        .agg(F.sha2(ordered(entry), 256).alias("_leaf"))
    )
    return leaves.groupBy(*keys).agg(F.sha2(ordered(F.concat("_bucket", F.lit(":"), "_leaf")), 256).alias(name))


def repo_revision(files: DataFrame, key: str = "review_id") -> DataFrame:
    """Hash of the (path, content hash) set of each repository."""
    return tree_digest(files, [key], F.concat(F.col("path"), F.lit(":"), F.col("sha256")), "revision")


def artifact_key(
    files: DataFrame, revisions: DataFrame, decisions: DataFrame, audits: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Hash per review over everything its exports depend on; an equal key means the old export is still good.

    An audit's ``revision_retained`` and ``reason`` and a review's ``summary`` count where the tables have them.
    """

    def tagged(df: DataFrame, tag: str, *columns: str) -> DataFrame:
        optional = [name for name in ("revision_retained", "reason", "summary") if tag in ("audit", "status") and name in df.columns]
        parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (*columns, *optional)]
        return df.select("review_id", F.concat_ws(":", F.lit(tag), *parts).alias("item"))

    rows = (
        tagged(files, "file", "file_id", "sha256")
        .unionByName(tagged(revisions, "revision", "revision_id", "after_sha256", "undone_at"))
        .unionByName(tagged(decisions, "decision", "finding_id", "decision"))
        .unionByName(tagged(audits, "audit", "finding_id", "action", "decision", "created_at"))
        .unionByName(tagged(reviews, "status", "status"))
    )
    return tree_digest(rows, ["review_id"], F.col("item"), "artifact_key")
