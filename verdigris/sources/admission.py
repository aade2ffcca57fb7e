"""Admission of source files: reading, paths, text checks, size limits, language."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.arrow import newline_offsets, nfc
from verdigris.functions.text import utf8_bytes
from verdigris.operators.running import first_n

# Limits on what may enter a review.
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_REVIEW_BYTES = 8 * 1024 * 1024
MAX_IMPORT_BYTES = 10 * 1024 * 1024
MAX_IMPORT_FILES = 200
MAX_CONTROL_RATIO = 0.01

# Languages by file extension, of uploads; of local versions, which may also be C; and of merge requests.
EXTENSIONS = {
    ".py": "python",
    ".pyw": "python",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hh": "cpp",
    ".hpp": "cpp",
    ".hxx": "cpp",
}
LOCAL_EXTENSIONS = EXTENSIONS | {".c": "cpp", ".h": "cpp"}
MERGE_EXTENSIONS = {suffix: language for suffix, language in LOCAL_EXTENSIONS.items() if suffix != ".pyw"}

# Patterns that score a text as one of the two languages, as (points, [patterns that must all match]).
UNSUPPORTED_PATTERNS = (
    r"(?iUmd)^\s*(?:function\s+\w+\s*\(|(?:let|var)\s+\w+\s*=|console\.)",
    r"(?iUmd)^\s*(?:const|let|var)\s+\w+\s*=.*=>",
    r"(?iUmd)^\s*class\s+\w+\s*\{[\s\S]*\bconstructor\s*\(",
)
PYTHON_PATTERNS = (
    (
        3,
        [
            r"(?Ud)(^|\n)\s*(?:(?:async\s+)?def\s+\w+\s*\([^)]*\)(?:\s*->\s*[^:\n]+)?|class\s+\w+(?:\([^)]*\))?)\s*:"
            r"|(^|\n)\s*(?:import|from)\b"
        ],
    ),
    (3, [r"(?Ud)\b(print|eval|exec|input)\s*\("]),
    (2, [r"(?Umd)^\s*[A-Za-z_]\w*\s*=(?!=)[^;\n]*$"]),
    (3, [r"(?Umd)^\s*[A-Za-z_]\w*\s*:\s*[^=\n]+(?:=\s*[^;\n]+)?$"]),
    (1, [r"(?Umd)^\s{4,}\S+", r"(?Ud):\s*(\n|$)"]),
)
CPP_PATTERNS = (
    (4, [r'(?Ud)#include\s*[<"]']),
    (3, [r"(?Ud)\bstd::\w+|using\s+namespace\s+std\b"]),
    (3, [r"(?Ud)\b(?:int|void|auto|bool|string)\s+main\s*\("]),
    (
        3,
        [
            r"(?Ud)\b[A-Za-z_]\w*(?:::\w+)*(?:<[^;{}\n]+>)?\s*[*&]?\s+\w+\s*\([^;{}]*\)\s*(?:const\s*)?\{"
        ],
    ),
    (1, [r"(?Umd)[{}]\s*$|;\s*(?:\n|$)"]),
    (1, [r"(?Ud)\b(?:int|void|char|float|double)\s+\w+\s*(?:=|;)"]),
)
CPP_TYPE_PATTERN = r"(?Ud)\b(?:class|struct|enum)\s+\w+"
CPP_ACCESS_PATTERN = r"(?Ud)\b(?:public|private|protected)\s*:"
CPP_TYPE_POINTS = 3


def read_source_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` as (path, content); decoding is lossy, so bad bytes show up as U+FFFD."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    return raw.select("path", F.decode("content", "UTF-8").alias("content"))


def load_files(df: DataFrame) -> DataFrame:
    """Add the content hash and the newline offsets."""
    return df.withColumn("sha256", F.sha2("content", 256)).withColumn("line_offsets", newline_offsets("content"))


def canonical_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``canonical_path``, its case-insensitive ``path_key`` and ``path_error``."""
    cleaned = F.trim(F.replace(nfc(F.col(path)), F.lit("\\"), F.lit("/")))
    absolute = (cleaned == "") | cleaned.startswith("/") | cleaned.rlike("^[A-Za-z]:")

    def step(kept: Column, part: Column) -> Column:
        climbs = (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & climbs, F.slice(kept, F.lit(1), F.size(kept) - 1))
            .otherwise(F.array_append(kept, part))
        )

    parts = F.aggregate(F.split("_cleaned", "/"), F.array().cast("array<string>"), step)
    bad = F.col("_absolute") | (F.size("_parts") == 0) | F.array_contains("_parts", "..")
    return (
        df.withColumns({"_cleaned": cleaned})
        .withColumns({"_absolute": absolute, "_parts": parts})
        .withColumns({"path_error": F.when(bad, F.lit("invalid_path"))})
        .withColumns(
            {
                "canonical_path": F.when(~bad, F.array_join("_parts", "/")),
                "path_key": F.when(~bad, F.lower(F.array_join("_parts", "/"))),
            }
        )
        .drop("_cleaned", "_absolute", "_parts")
    )


def admit_files(
    df: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_control_ratio: float = MAX_CONTROL_RATIO
) -> DataFrame:
    """Add ``reject_reason``; null means admitted. Split with ``accepted`` and ``quarantined``."""
    content = F.col("content")
    control = F.regexp_count(content, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    reason = (
        F.when(utf8_bytes(content) > max_bytes, "too_large")
        .when(~content.rlike(r"(?U)\S"), "blank")
        .when(content.contains("\x00"), "nul_character")
        .when(content.contains("�"), "replacement_character")
        .when(control / F.greatest(F.lit(1), F.length(content)) > max_control_ratio, "control_characters")
    )
    return df.withColumn("reject_reason", reason)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def path_conflicts(df: DataFrame, batch: str = "review_id") -> DataFrame:
    """Every member of a path key that occurs more than once in one import."""
    keyed = df.where(F.col("path_key").isNotNull())
    clashing = keyed.groupBy(batch, "path_key").count().where("count > 1").drop("count")
    return keyed.join(clashing, [batch, "path_key"], "left_semi")


def cap_import_bytes(
    df: DataFrame,
    order: list[Column],
    batch: str = "review_id",
    cap: int = MAX_IMPORT_BYTES,
    max_files: int = MAX_IMPORT_FILES,
) -> DataFrame:
    """Files admitted before the byte budget of their import ran out.

    Sticky: the first file that does not fit ends the import, and so does reaching the cap exactly.
    Only the first ``max_files`` can ever be admitted, so each import is cut to them before the running sum.
    """
    head = first_n(df.withColumn("size", utf8_bytes("content").cast("long")), [batch], order, max_files, "position")
    running = Window.partitionBy(batch).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = head.withColumn("cumulative_bytes", F.sum("size").over(running))
    return total.where((F.col("cumulative_bytes") <= cap) & (F.col("cumulative_bytes") - F.col("size") < cap))


def reject_oversize_import(df: DataFrame, batch: str = "review_id", cap: int = MAX_REVIEW_BYTES) -> DataFrame:
    """Files of the imports whose total size is within the cap."""
    fitting = df.groupBy(batch).agg(F.sum(utf8_bytes("content")).alias("total")).where(F.col("total") <= cap)
    return df.join(fitting.select(batch), batch, "left_semi")


def extension_language(path: str | Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    """Language by file extension; null for one that the caller's table doesn't have."""
    value = F.lower(F.col(path) if isinstance(path, str) else path)
    suffix = F.regexp_extract(value, r"[^/](\.[^./]+)$", 1)
    table = F.create_map(*[F.lit(item) for pair in extensions.items() for item in pair])
    return F.when(suffix != "", F.try_element_at(table, suffix))


def detect_language(
    df: DataFrame, content: str = "content", path: str = "path", declared: str | None = None, extensions: dict[str, str] = EXTENSIONS
) -> DataFrame:
    """Add ``python_score``, ``cpp_score``, ``detected`` and ``language_error``; ``extensions`` are those that are taken."""
    text = F.col(content)

    def points(table) -> Column:
        return reduce(
            add,
            [
                F.when(reduce(lambda a, b: a & b, [text.rlike(pattern) for pattern in patterns]), score).otherwise(0)
                for score, patterns in table
            ],
        )

    by_name = extension_language(path, extensions)
    has_suffix = F.regexp_extract(F.col(path), r"[^/](\.[^./]+)$", 1) != ""
    cpp_type = (F.coalesce(by_name == "cpp", F.lit(False)) | text.rlike(CPP_ACCESS_PATTERN)) & text.rlike(CPP_TYPE_PATTERN)
    scored = df.withColumns(
        {
            "python_score": points(PYTHON_PATTERNS),
            "cpp_score": points(CPP_PATTERNS) + F.when(cpp_type, CPP_TYPE_POINTS).otherwise(0),
        }
    )
    python, cpp = F.col("python_score"), F.col("cpp_score")
    found = F.when((python >= 2) & (python >= cpp + 1), "python").when((cpp >= 2) & (cpp >= python + 1), "cpp")
    unsupported = reduce(lambda a, b: a | b, [text.rlike(pattern) for pattern in UNSUPPORTED_PATTERNS])
    wanted = F.col(declared) if declared else F.lit(None).cast("string")
    error = (
        F.when(wanted.isNotNull() & ~wanted.isin("python", "cpp"), "unsupported_language")
        .when(has_suffix & by_name.isNull(), "unsupported_extension")
        .when(unsupported, "unsupported_syntax")
        .when(found.isNull(), "not_recognised")
        .when(wanted.isNotNull() & (wanted != found), "declared_language_differs")
        .when(by_name.isNotNull() & (by_name != found), "extension_differs")
    )
    return scored.withColumns({"detected": found, "language_error": error})
