"""Jobs that keep the tables in order: deletion cascades, activation, audits. Pure joins; see sinks for writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.sifting import without
from verdigris.session import settle
from verdigris.sinks.keyed import KeyedTable

CHILD_TABLES = ("files", "findings", "chunks", "attempts", "model_runs", "events", "revisions", "followups")
RESET_TABLES = ("findings", "chunks", "attempts", "model_runs")


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the doomed reviews and their children. ``doomed``: review_id."""
    ids = settle(doomed.select("review_id").distinct(), "doomed-reviews")
    return {name: without(df, ids, ["review_id"]) if "review_id" in df.columns else df for name, df in tables.items()}


def reset_review(tables: dict[str, DataFrame], restarted: DataFrame) -> dict[str, DataFrame]:
    """Results of the restarted reviews are dropped; their events stay, so sequences go on."""
    ids = settle(restarted.select("review_id").distinct(), "restarted-reviews")
    return {name: without(df, ids, ["review_id"]) if name in RESET_TABLES else df for name, df in tables.items()}


def purge_outcome(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """What happens to each of the wanted users: purged, or refused as ``protected`` (admins) or ``unknown``."""
    return wanted.select("user_id").distinct().join(users.select("user_id", "role"), "user_id", "left").select(
        "user_id", F.when(F.col("role").isNull(), "unknown").when(F.col("role") == "admin", "protected").otherwise("purged").alias("result")
    )


def purge_users(tables: dict[str, DataFrame], wanted: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Everything without the wanted users, and what happened to each of them.

    Admins and unknown users are refused. Tables: users, reviews, auth_sessions and any child tables.
    """
    outcome = settle(purge_outcome(tables["users"], wanted), "purge-outcome")
    gone = outcome.where("result = 'purged'").select("user_id")
    reviews = tables["reviews"].join(gone.withColumnRenamed("user_id", "owner_id"), "owner_id", "left_semi").select("review_id")
    left = cascade_delete(tables, reviews)
    for name in ("users", "auth_sessions"):
        if name in left:
            left[name] = without(left[name], gone, ["user_id"])
    return left, outcome


def delete_reviews(tables: dict[str, KeyedTable], doomed: DataFrame) -> dict[str, list[int]]:
    """Deletes the doomed reviews and their children from tables bucketed by review; returns the buckets rewritten in each.

    Each table goes to its next version by itself; run again after a failure, the job finds what is left. For a restart
    (``reset_review``) give it the tables of ``RESET_TABLES`` only.
    """
    ids = doomed.select("review_id").distinct()
    return {name: table.delete(ids) for name, table in tables.items() if table.bucket_by == ["review_id"]}


def purge_users_from(tables: dict[str, KeyedTable], wanted: DataFrame) -> tuple[dict[str, list[int]], DataFrame]:
    """``purge_users`` on keyed tables: rewrites only buckets that hold a purged user or one of their reviews.

    Reviews and their children are bucketed by review_id, users and sessions by user_id. Users go last, so that a job run again
    after a failure still knows whom it was to purge. Returns the buckets rewritten and what happened to each user.
    """
    outcome = settle(purge_outcome(tables["users"].read(), wanted), "purge-outcome")
    gone = outcome.where("result = 'purged'").select("user_id")
    owned = tables["reviews"].read().join(gone.withColumnRenamed("user_id", "owner_id"), "owner_id", "left_semi").select("review_id")
    doomed = settle(owned, "purge-reviews")
    children = {name: table for name, table in tables.items() if name != "reviews"}
    touched = delete_reviews(children, doomed) | delete_reviews({"reviews": tables["reviews"]}, doomed)
    for name in ("auth_sessions", "users"):
        if name in tables:
            touched[name] = tables[name].delete(gone)
    return touched, outcome


def batch_set_active(users: DataFrame, wanted: DataFrame, active: bool) -> DataFrame:
    """Result per distinct wanted user: ok, unknown, or protected for admins."""
    joined = wanted.select("user_id").distinct().join(users.select("user_id", "role"), "user_id", "left")
    error = F.when(F.col("role").isNull(), "unknown").when(F.col("role") != "user", "protected")
    return joined.select("user_id", error.isNull().alias("ok"), error.alias("error"), F.lit(active).alias("active"))


def apply_activation(users: DataFrame, results: DataFrame) -> DataFrame:
    """Users after the accepted changes."""
    changes = results.where("ok").select("user_id", F.col("active").alias("_active"))
    return users.join(changes, "user_id", "left").withColumn("is_active", F.coalesce("_active", "is_active")).select(*users.columns)


def drop_disabled_sessions(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions without those of users just disabled."""
    return sessions.join(results.where("ok AND NOT active").select("user_id"), "user_id", "left_anti")


def isolation_audit(children: DataFrame, reviews: DataFrame) -> DataFrame:
    """Child rows whose owner is not the owner of their review, or whose review does not exist."""
    owners = reviews.select("review_id", F.col("owner_id").alias("_owner"))
    joined = children.join(owners, "review_id", "left")
    problem = F.when(F.col("_owner").isNull(), "no_review").when(F.col("_owner") != F.col("owner_id"), "other_owner")
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_owner")


def expire(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """Batch twin of the time-to-live stream: expired reviews go with their children; a null expiry means never."""
    doomed = tables["reviews"].where(F.col("expires_at") <= now).select("review_id")
    return cascade_delete(tables, doomed)
