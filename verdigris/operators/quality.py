"""Data-quality checks on the review tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def broken_rules(df: DataFrame, rules: dict[str, Column], name: str = "broken_rules") -> DataFrame:
    """Add the sorted names of the rules a row breaks. A null condition counts as broken."""
    marks = [F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(rule)) for rule, ok in sorted(rules.items())]
    return df.withColumn(name, F.array_compact(F.array(*marks)))


def finding_rules() -> dict[str, Column]:
    """The constraints every stored finding has to meet."""
    return {
        "confidence_in_unit_range": F.col("confidence").between(0.0, 1.0),
        "end_not_before_start": F.struct("end_line", "end_column") >= F.struct("start_line", "start_column"),
        "evidence_present": F.length("evidence") > 0,
        "positive_lines": (F.col("start_line") >= 1) & (F.col("end_line") >= 1),
        "severity_known": F.col("severity").isin("critical", "high", "medium", "low", "info"),
        "source_known": F.col("source").isin("static", "llm"),
    }


# A hash as stored, the states of a chunk, the languages, the most items of a model's answer.
HASH = "^[0-9a-f]{64}$"
CHUNK_STATES = ("pending", "queued", "running", "validating", "completed", "failed", "cancelled", "superseded")
LANGUAGES = ("python", "cpp")
MAX_ANSWER_ITEMS = 50


def _present(*names: str) -> dict[str, Column]:
    return {f"{name}_present": F.length(F.col(name)) > 0 for name in names}


def _not_negative(*names: str) -> dict[str, Column]:
    """Optional numbers: one that is not given counts as zero."""
    return {f"{name}_not_negative": F.coalesce(F.col(name), F.lit(0)) >= 0 for name in names}


def draft_rules() -> dict[str, Column]:
    """The constraints every finding of a model's answer has to meet."""
    return {
        **_present("rule_id", "category", "file", "title", "evidence", "impact", "suggestion"),
        "confidence_in_unit_range": F.col("confidence").between(0.0, 1.0),
        "severity_known": F.col("severity").isin("critical", "high", "medium", "low", "info"),
        "positive_lines": (F.col("start_line") >= 1) & (F.col("end_line") >= 1),
        "end_not_before_start": F.col("end_line") >= F.col("start_line"),
    }


def answer_rules() -> dict[str, Column]:
    """The constraints of a model's answer as a whole: ``summary``, ``findings``, ``uncovered``."""
    return {
        **_present("summary"),
        "findings_at_most_50": F.size("findings") <= MAX_ANSWER_ITEMS,
        "uncovered_at_most_50": F.size("uncovered") <= MAX_ANSWER_ITEMS,
    }


def file_rules() -> dict[str, Column]:
    """The constraints of a stored source file."""
    return {**_present("file_id", "path"), "language_known": F.col("language").isin(*LANGUAGES), "hash_well_formed": F.col("sha256").rlike(HASH)}


def chunk_rules() -> dict[str, Column]:
    """The constraints of a chunk of a review."""
    return {
        **_present("chunk_id", "review_id", "target_file_id", "target_path"),
        **_not_negative("prompt_tokens_estimate", "output_tokens_budget", "split_depth", "attempt_count"),
        "language_known": F.col("language").isin(*LANGUAGES),
        "status_known": F.col("status").isin(*CHUNK_STATES),
        "hash_well_formed": F.col("content_fingerprint").rlike(HASH),
        "positive_lines": (F.col("target_start_line") >= 1) & (F.col("target_end_line") >= 1),
        "end_not_before_start": F.col("target_end_line") >= F.col("target_start_line"),
    }


def claim_rules(claim: str = "root_cause") -> dict[str, Column]:
    """The constraints of a root-cause claim, a struct; a row without a claim breaks none of them."""
    inside = F.col(claim)
    given = ("claim", "concrete_failing_input", "expected_behavior", "actual_behavior", "affected_path", "repair_invariant")
    rules = {f"{name}_present": F.length(inside[name]) > 0 for name in given}
    shown = [F.coalesce(F.length(inside[name]) > 0, F.lit(False)) for name in ("contract_evidence", "reachable_path")]
    rules["claim_verifiable"] = shown[0] | shown[1]
    return {name: inside.isNull() | F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}


def schema_problems(df: DataFrame, expected: T.StructType, keys: list[str]) -> DataFrame:
    """Everything about a table's form that is not as expected, as rows (problem, rows): schema differences, null and repeated keys."""
    lines = df.sparkSession.createDataFrame([(line, 0) for line in schema_differences(df, expected)], "problem string, rows long")
    known = [key for key in keys if key in df.columns]
    if not known:
        return lines
    missing = reduce(or_, [F.col(key).isNull() for key in known])
    nulls = df.where(missing).agg(F.lit("null key").alias("problem"), F.count(F.lit(1)).alias("rows"))
    again = duplicate_keys(df.where(~missing), known).agg(F.lit("repeated key").alias("problem"), F.count(F.lit(1)).alias("rows"))
    return lines.unionByName(nulls.unionByName(again).where("rows > 0"))


def rule_counts(checked: DataFrame, name: str = "broken_rules") -> DataFrame:
    """How many rows break each rule."""
    return checked.select(F.explode(name).alias("rule")).groupBy("rule").count().withColumnRenamed("count", "rows")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent."""
    parents = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def require_no_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> None:
    if not orphans(child, parent, key, parent_key).isEmpty():
        raise ValueError(f"rows without a parent for {key}")


def schema_differences(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences in names, types and nullability, one line each; works on the schema only."""
    have = {field.name: field for field in df.schema.fields}
    want = {field.name: field for field in expected.fields}
    lines = [f"missing column {name}" for name in want if name not in have]
    lines += [f"unexpected column {name}" for name in have if name not in want]
    for name in want:
        if name in have and have[name].dataType != want[name].dataType:
            lines.append(f"{name} is {have[name].dataType.simpleString()}, expected {want[name].dataType.simpleString()}")
        elif name in have and have[name].nullable and not want[name].nullable:
            lines.append(f"{name} must not be nullable")
    return lines


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def backfill_owner(df: DataFrame, default_owner: object, column: str = "owner_id") -> DataFrame:
    """Rows without an owner go to the default one; rows are never added or lost."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default_owner)))


def sole_admin(users: DataFrame) -> DataFrame:
    """The admin to own old rows; empty unless there is exactly one."""
    counted = users.where("role = 'admin'").agg(F.count(F.lit(1)).alias("admins"), F.min("user_id").alias("user_id"))
    return counted.where("admins = 1").select("user_id")


def import_inconsistencies(selected: DataFrame, files: DataFrame, ranges: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Everything about an import that does not fit together, as (review_id, path, problem).

    ``selected`` and ``base`` hold (review_id, path); ``files`` adds line_count; ``ranges`` adds end_line.
    """
    key = ["review_id", "path"]

    def problem(df: DataFrame, label: str) -> DataFrame:
        return df.select(*key, F.lit(label).alias("problem")).distinct()

    beyond = ranges.groupBy(*key).agg(F.max("end_line").alias("last")).join(files.select(*key, "line_count"), key).where(
        F.col("last") > F.greatest(F.lit(1), F.col("line_count"))
    )
    found = [
        problem(selected.join(files.select(*key), key, "left_anti"), "selected_without_file"),
        problem(ranges.join(selected.select(*key), key, "left_anti"), "range_of_unselected_path"),
        problem(beyond, "range_beyond_file"),
    ]
    if base is not None:
        found.append(problem(base.join(selected.select(*key), key, "left_anti"), "base_not_selected"))
        found.append(problem(selected.join(base.select(*key), key, "left_anti"), "selected_without_base"))
    return reduce(DataFrame.unionByName, found)
