"""Reports of outside tools: merge-request diffs, linter JSON, compiler logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.text import split_lines
from verdigris.operators.running import earliest
from verdigris.sources.admission import MERGE_EXTENSIONS, extension_language

# Limits and patterns of the report formats.
MAX_DIFF_CHARS = 40_000
HUNK_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
COMPILER_LINE = r"^(.+?):(\d+):(\d+):\s+(error|warning):\s+(.+)$"

DIFF = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("new_path", T.StringType()),
        T.StructField("new_file", T.BooleanType()),
        T.StructField("deleted_file", T.BooleanType()),
        T.StructField("renamed_file", T.BooleanType()),
        T.StructField("generated_file", T.BooleanType()),
        T.StructField("collapsed", T.BooleanType()),
        T.StructField("too_large", T.BooleanType()),
        T.StructField("diff", T.StringType()),
    ]
)
_POSITION = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType())])
DIAGNOSTIC = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("location", _POSITION),
        T.StructField("end_location", _POSITION),
    ]
)


def read_merge_request_diffs(spark: SparkSession, path: str) -> DataFrame:
    return merge_request_changes(spark.read.schema(DIFF).json(path))


def merge_request_changes(raw: DataFrame) -> DataFrame:
    """Raw diff rows → change type, language, cut diff, selectability with its reason."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    target = F.when(F.coalesce(F.col("new_path"), F.lit("")) == "", F.col("old_path")).otherwise(F.col("new_path"))
    diff = F.coalesce(F.col("diff"), F.lit(""))
    cut = flag("collapsed") | flag("too_large") | (F.length(diff) > MAX_DIFF_CHARS)
    language = extension_language(target, MERGE_EXTENSIONS)
    reason = (
        F.when(language.isNull(), "unsupported_language")
        .when(flag("generated_file"), "generated_file")
        .when(cut, "incomplete_diff")
        .when(F.col("change_type") == "deleted", "deleted_file")
    )
    return (
        raw.withColumn(
            "change_type",
            F.when(flag("new_file"), "added").when(flag("deleted_file"), "deleted")
            .when(flag("renamed_file"), "renamed").otherwise("modified"),
        )
        .withColumns({"unavailable_reason": reason, "diff_truncated": cut, "language": language})
        .withColumns(
            {
                "new_path": target,
                "diff": F.substring(diff, 1, MAX_DIFF_CHARS),
                "selectable": F.col("unavailable_reason").isNull(),
            }
        )
        .select(
            "review_id", "old_path", "new_path", "change_type", "language", "diff", "diff_truncated",
            "selectable", "unavailable_reason",
        )
    )


def hunk_ranges(changes: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Line ranges on the new side, one per hunk header; hunks that add no line have none."""
    headers = F.filter(split_lines(diff), lambda line: line.rlike(HUNK_HEADER))
    rows = changes.select(*keys, F.explode(headers).alias("header"))
    length = F.regexp_extract("header", HUNK_HEADER, 2)
    sized = rows.select(
        *keys,
        F.regexp_extract("header", HUNK_HEADER, 1).cast("int").alias("start_line"),
        F.when(length == "", F.lit(1)).otherwise(length.cast("int")).alias("count"),
    )
    return sized.where("count > 0").select(*keys, "start_line", (F.col("start_line") + F.col("count") - 1).alias("end_line"))


def load_diagnostics(rows: DataFrame, analyzer: str, keys: list[str]) -> DataFrame:
    """Linter rows (``DIAGNOSTIC`` fields) → standard diagnostics; other codes are dropped."""
    at_least_one = lambda value: F.greatest(F.lit(1), F.coalesce(value, F.lit(1)))
    row, column = F.col("location.row"), F.col("location.column")
    message = F.lower("message")
    rule = F.when(
        (F.lower("code") == "f821") | message.contains("undefined name"), "python.undefined-name"
    ).when((F.lower("code") == "f401") | message.contains("imported but unused"), "python.unused-import")
    quoted = F.regexp_extract("message", "`([^`]+)`", 1)
    return (
        rows.where(F.col("code").isNotNull() & F.col("message").isNotNull())
        .withColumn("rule_id", rule)
        .where(F.col("rule_id").isNotNull())
        .select(
            *keys,
            F.lit(analyzer).alias("analyzer_id"),
            "rule_id",
            F.when(F.col("code").rlike("^(E9|F)"), "error").otherwise("warning").alias("severity"),
            at_least_one(row).alias("start_line"),
            at_least_one(column).alias("start_column"),
            at_least_one(F.coalesce(F.col("end_location.row"), row)).alias("end_line"),
            at_least_one(F.coalesce(F.col("end_location.column"), column)).alias("end_column"),
            F.when(quoted != "", quoted).otherwise(F.col("message")).alias("evidence"),
            "message",
        )
    )


def load_compiler_log(log: DataFrame, files: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """Compiler lines → findings; only lines about files of the review are kept."""
    part = lambda at: F.regexp_extract(line, COMPILER_LINE, at)
    level = F.col("level")
    parsed = log.where(F.col(line).rlike(COMPILER_LINE)).select(
        *keys,
        part(1).alias("path"),
        part(2).cast("int").alias("start_line"),
        part(3).cast("int").alias("start_column"),
        part(4).alias("level"),
        part(5).alias("message"),
    )
    known = files.select(*keys, "path").distinct()
    return parsed.join(known, [*keys, "path"], "left_semi").select(
        *keys,
        "path",
        "start_line",
        "start_column",
        F.concat(F.lit("cpp.compiler-"), level).alias("rule_id"),
        F.when(level == "error", "medium").otherwise("low").alias("severity"),
        "message",
    )


def merge_diagnostics(builtin: DataFrame, tool: DataFrame, keys: list[str]) -> DataFrame:
    """Built-in rows plus the tool rows at new (rule, line, column); the first tool row of a position wins."""
    identity = [*keys, "rule_id", "start_line", "start_column"]
    fresh = earliest(tool, identity, ["evidence"]).join(builtin.select(*identity), identity, "left_anti")
    return builtin.unionByName(fresh)


