"""Rollups. All are map-side combined group-bys; none collects a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import estimate_tokens, split_lines

# Levels, thresholds and precedences of the rollups.
SEVERITIES = ("critical", "high", "medium", "low", "info")
COMPLEX_LINES = 500
COMPLEX_TOKENS = 12_000
RUNNING_CHUNKS = ("running", "validating")
QUEUED_CHUNKS = ("pending", "queued")
LOCAL_FAILURES = ("local_model_circuit_open", "local_model_connection_refused", "local_model_timeout")
DISPLAY_ZONE = "Asia/Shanghai"


def severity_summary(findings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Counts per severity and in total for each review; reviews without findings get zeros."""
    counted = findings.groupBy("review_id").agg(
        *[F.count_if(F.col("severity") == level).alias(level) for level in SEVERITIES],
        F.count(F.lit(1)).alias("total"),
    )
    if reviews is None:
        return counted
    return reviews.select("review_id").join(counted, "review_id", "left").fillna(0, [*SEVERITIES, "total"])


def chunk_progress(chunks: DataFrame, key: str = "review_id") -> DataFrame:
    """Progress over leaf chunks; a review without leaves is at 100 percent."""
    leaf = F.col("status") != "superseded"
    total = F.count_if(leaf)
    completed = F.count_if(F.col("status") == "completed")
    return chunks.groupBy(key).agg(
        total.alias("total"),
        completed.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(*RUNNING_CHUNKS)).alias("running"),
        F.count_if(F.col("status").isin(*QUEUED_CHUNKS)).alias("queued"),
        F.when(total == 0, 100.0).otherwise(completed * 100.0 / total).alias("percent"),
    )


def matched_tuples(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tuples of both sides with the flags ``expected`` and ``actual``; one shuffle for both."""
    left = expected.select(*keys, F.lit(True).alias("expected"), F.lit(False).alias("actual"))
    right = actual.select(*keys, F.lit(False).alias("expected"), F.lit(True).alias("actual"))
    return left.unionByName(right).groupBy(*keys).agg(F.max("expected").alias("expected"), F.max("actual").alias("actual"))


def golden_metrics(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and negatives over sets of (case, rule, path, line), and the rates from them.

    ``false_positive_rate`` is the share of actual findings that were not expected; ``location_accuracy`` equals
    precision, because the line is part of the tuple.
    """
    counts = matched_tuples(expected, actual, keys).agg(
        F.count_if(F.col("expected") & F.col("actual")).alias("true_positive"),
        F.count_if(~F.col("expected") & F.col("actual")).alias("false_positive"),
        F.count_if(F.col("expected") & ~F.col("actual")).alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    ratio = lambda part, whole, empty: F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp, 1.0),
            "recall": ratio(tp, tp + fn, 1.0),
            "false_positive_rate": ratio(fp, tp + fp, 0.0),
            "location_accuracy": ratio(tp, tp + fp, 1.0),
        }
    )


def rate_or_one(flag: Column, invert: bool = False) -> Column:
    """Mean of a flag, 1.0 when there is none; inverted for regressions."""
    mean = F.avg(flag.cast("int"))
    return F.coalesce(1 - mean if invert else mean, F.lit(1.0))


def golden_failures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One line per expected finding that is missing and per actual one that is unexpected."""
    keys = ["case_id", "rule_id", "path", "line"]
    wrong = matched_tuples(expected, actual, keys).where(F.col("expected") != F.col("actual"))
    kind = F.when(F.col("expected"), "missing").otherwise("unexpected")
    return wrong.select("case_id", F.format_string("%s: %s %s at %s:%d", "case_id", kind, "rule_id", "path", "line").alias("failure"))


def policy_suggestions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """How often findings of each rule were dismissed; a hint for people, nothing is switched off."""
    dismissed = decisions.where("decision = 'dismissed'").select("finding_id").distinct()
    return findings.join(dismissed, "finding_id", "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("dismissed_count"))


def user_stats(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"), F.count_if(~F.col("is_active")).alias("disabled")
    )


def counter_totals(increments: DataFrame) -> DataFrame:
    """Total per counter name. ``increments``: (name, amount)."""
    return increments.groupBy("name").agg(F.sum("amount").alias("total"))


def cache_ratio(counters: DataFrame, hits: str, misses: str) -> DataFrame:
    """Share of hits among two counters; 0 when neither was counted."""
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("total"))), F.lit(0))
    both = total(hits) + total(misses)
    return counters.agg(
        total(hits).alias("hits"), total(misses).alias("misses"), F.when(both == 0, 0.0).otherwise(total(hits) / both).alias("hit_ratio")
    )


def review_shape(files: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Size of each review and whether it is complex. ``modes``: (review_id, mode)."""
    sized = files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(F.greatest(F.lit(1), F.size(split_lines("content")))).alias("total_lines"),
        F.sum(estimate_tokens("content").cast("long")).alias("input_tokens"),
    )
    joined = sized.withColumn("mode", F.lit("single")) if modes is None else sized.join(modes, "review_id", "left")
    big = (F.col("file_count") > 1) | (F.col("total_lines") >= COMPLEX_LINES) | (F.col("input_tokens") >= COMPLEX_TOKENS)
    return joined.withColumn("complex", F.coalesce(F.col("mode") == "project", F.lit(False)) | big)


def route_model(available: Column, is_complex: Column, manual: Column | None = None) -> Column:
    """Model for a review: the manual choice if it exists, else the first name holding the preferred marker."""
    names = F.sort_array(F.array_distinct(F.filter(F.transform(available, F.trim), lambda name: name != "")))
    holding = lambda marker: F.get(F.filter(names, lambda name: F.contains(F.lower(name), F.lit(marker))), F.lit(0))
    automatic = F.when(is_complex, F.coalesce(holding("pro"), holding("flash"))).otherwise(F.coalesce(holding("flash"), holding("pro")))
    chosen = F.coalesce(automatic, F.get(names, F.lit(0)))
    if manual is None:
        return chosen
    return F.when(manual.isNull(), chosen).when(F.array_contains(names, manual), manual)


def inference_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Latency percentiles, throughput and success share per group.

    ``percentile`` keeps one counter per distinct whole millisecond, and request timeouts bound those.
    """
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.percentile("latency_ms", 0.5).alias("p50_ms"),
        F.percentile("latency_ms", 0.95).alias("p95_ms"),
        F.percentile("first_delta_ms", 0.95).alias("first_delta_p95_ms"),
        (F.sum("tokens") * 1000 / F.sum("latency_ms")).alias("tokens_per_second"),
        (F.count_if(F.col("ok")) * 100 / F.count(F.lit(1))).alias("success_percent"),
    )


def token_usage(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums per group; ``cache_hit_ratio`` is null without any cache figures."""
    cached = F.sum(F.coalesce("prompt_cache_hit_tokens", F.lit(0)))
    missed = F.sum(F.coalesce("prompt_cache_miss_tokens", F.lit(0)))
    return runs.groupBy(*keys).agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        cached.alias("cache_hit_tokens"),
        missed.alias("cache_miss_tokens"),
        F.when(cached + missed > 0, cached / (cached + missed)).alias("cache_hit_ratio"),
    )


def attempt_error_code(df: DataFrame) -> DataFrame:
    """Error code of a failed attempt from its ``error_kind``; connection details count for local models only."""
    kind = F.col("error_kind")
    local = F.col("model_profile").startswith("local-")
    code = (
        F.when(kind.isNull(), None)
        .when(kind == "context_overflow", "context_overflow")
        .when(local & (kind == "circuit_open"), "local_model_circuit_open")
        .when(local & (kind == "timeout"), "local_model_timeout")
        .when(local & (kind == "connection_refused"), "local_model_connection_refused")
        .otherwise("model_error")
    )
    return df.withColumn("error_code", code)


def review_failure_cause(failed: DataFrame) -> DataFrame:
    """Why a review failed. ``failed``: (review_id, error_code, planning_error), a row per attempt.

    The cause shown prefers overflow, then planning, then a local model fault; the code prefers the local one.
    """
    planning = F.max(F.when(F.col("planning_error") != "coverage_incomplete", F.col("planning_error")))
    any_planning = F.max("planning_error")
    overflow = F.max(F.coalesce(F.col("error_code") == "context_overflow", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(code) for code in LOCAL_FAILURES]), F.col("error_code"))
    local = F.min_by("error_code", F.when(rank > 0, rank))
    grouped = failed.groupBy("review_id").agg(
        overflow.alias("_overflow"), planning.alias("_planning"), any_planning.alias("_any_planning"),
        F.when(F.max(F.coalesce(rank, F.lit(0))) > 0, local).alias("_local"),
    )
    cause = (
        F.when(F.col("_overflow"), "context_overflow")
        .when(F.col("_planning").isNotNull(), "planning")
        .when(F.col("_local").isNotNull(), "local_model")
        .otherwise("other")
    )
    return grouped.select(
        "review_id",
        cause.alias("cause"),
        (~cause.isin("context_overflow", "planning")).alias("retryable"),
        F.coalesce("_local", "_any_planning", F.lit("review_failed")).alias("code"),
    )


def graph_stats(calls: DataFrame, bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes and edges per review; an edge is a distinct called name or base of a symbol."""
    edges = (
        calls.select("review_id", "symbol_id", F.col("callee").alias("name"), F.lit("call").alias("kind"))
        .unionByName(bases.select("review_id", "symbol_id", F.col("base").alias("name"), F.lit("base").alias("kind")))
        .distinct()
        .groupBy("review_id")
        .agg(F.count(F.lit(1)).alias("edge_count"))
    )
    nodes = symbols.groupBy("review_id").agg(F.count(F.lit(1)).alias("node_count"))
    return nodes.join(edges, "review_id", "left").fillna(0, ["edge_count"])


def symbol_degree(calls: DataFrame) -> DataFrame:
    """Distinct names each symbol calls."""
    return calls.select("review_id", "symbol_id", "callee").distinct().groupBy("review_id", "symbol_id").agg(F.count(F.lit(1)).alias("degree"))


def history_items(reviews: DataFrame, files: DataFrame, summary: DataFrame, details: bool = False) -> DataFrame:
    """One row per review for the history list.

    ``reviews``: review_id, title, mode, status, created_at. With ``details`` also expires_at, error, origin and all columns of
    ``summary``, whose counts are zero where a review has none. A review holds at most a few hundred files
    (admission), so the list of names is bounded.
    """
    listed = files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sort_array(F.collect_list(F.struct("file_id", "path"))).alias("_files")
    )
    first = F.get("_files", F.lit(0))["path"]
    local_time = F.date_format(F.from_utc_timestamp("created_at", DISPLAY_ZONE), "yyyy-MM-dd HH:mm")
    title = (
        F.when(F.trim("title") != "", F.trim("title"))
        .when((F.col("mode") == "single") & first.isNotNull(), first)
        .when(
            F.col("mode") == "project",
            F.concat(F.lit("项目审查 · "), F.coalesce(first, F.lit("未命名项目")), F.lit(" 等 "), F.coalesce("file_count", F.lit(0)).cast("string"), F.lit(" 个文件")),
        )
        .otherwise(F.concat(F.lit("代码审查 · "), local_time))
    )
    counts = [name for name in summary.columns if name not in ("review_id", "total")] if details else []
    joined = reviews.join(listed, "review_id", "left").join(summary.select("review_id", "total", *counts), "review_id", "left")
    more = ["expires_at", "error", "origin", *(F.coalesce(name, F.lit(0)).alias(name) for name in counts)] if details else []
    return joined.select(
        "review_id", title.alias("title"), "mode", "status", "created_at",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.array_join(F.transform(F.coalesce("_files", F.array().cast("array<struct<file_id:bigint,path:string>>")), lambda item: item["path"]), "\n").alias("file_names"),
        F.coalesce("total", F.lit(0)).alias("findings"),
        *more,
    )


def recency_buckets(reviews: DataFrame, today: Column) -> DataFrame:
    """How many reviews are from today, the six days before, or older, on whole days."""
    days = F.datediff(F.to_date(today), F.to_date("created_at"))
    bucket = F.when(days <= 0, "today").when(days <= 6, "past_7_days").otherwise("older")
    return reviews.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("reviews"))


def analyzer_coverage(runs: DataFrame, fallback: str = "python-ast") -> DataFrame:
    """Per review and language: the analyzer that covered it and whether one was available.

    ``runs``: review_id, language, analyzer, available, failed; one failure makes the language fall back.
    """
    usable = F.bool_and(F.col("available") & ~F.col("failed"))
    return runs.groupBy("review_id", "language").agg(
        F.when(usable | (F.first("language") != "python"), F.max("analyzer")).otherwise(fallback).alias("analyzer"),
        F.when(F.first("language") == "python", True).otherwise(usable).alias("available"),
        (~usable).alias("fallback"),
    )


def outcome_breakdown(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings per rule and severity, split by what was decided about them."""
    outcomes = ["fixed", "accepted_risk", "dismissed", "deferred", "pending"]
    joined = findings.join(decisions.select("finding_id", "decision"), "finding_id", "left").withColumn(
        "decision", F.coalesce("decision", F.lit("pending"))
    )
    pivoted = joined.groupBy("rule_id", "severity").pivot("decision", outcomes).count()
    return pivoted.fillna(0, outcomes)
