"""What users plug in: analyzers, chunkers, judges, token estimators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest text handed to an analyzer.
MAX_ANALYZER_BYTES = 1_000_000

DIAGNOSTIC_ROW = "rule_id string, severity string, line int, column int, end_line int, end_column int, message string"
CHUNK_ROW = "chunk_index int, start_line int, end_line int"


def analyzable(files: DataFrame) -> DataFrame:
    """Files an analyzer may see: relative paths without a climb, of limited size."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    inside = ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    return files.where(inside & (F.octet_length("content") <= MAX_ANALYZER_BYTES))


def _rows_per_file(files: DataFrame, fn: Callable[[str, str], Iterable[tuple]], row_schema: str) -> DataFrame:
    names = [item.split()[0] for item in row_schema.split(", ")]
    key_type = dict(files.dtypes)["file_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (file_id, *row)
                for file_id, path, content in zip(batch["file_id"], batch["path"], batch["content"])
                for row in fn(path, content)
            ]
            yield pd.DataFrame(rows, columns=["file_id", *names])

    return files.select("file_id", "path", "content").mapInPandas(run, f"file_id {key_type}, {row_schema}")


def apply_analyzer(files: DataFrame, fn: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """Diagnostics of a user's analyzer; ``fn(path, content)`` yields tuples of ``DIAGNOSTIC_ROW``."""
    return _rows_per_file(analyzable(files), fn, DIAGNOSTIC_ROW)


def apply_chunker(files: DataFrame, fn: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """Chunks of a user's chunker; ``fn(path, content)`` yields tuples of ``CHUNK_ROW``."""
    return _rows_per_file(files, fn, CHUNK_ROW)


def register_analyzer(spark: SparkSession, name: str, fn: Callable[[str, str], Iterable[tuple]]) -> None:
    """Make an analyzer callable in SQL: ``SELECT ... FROM files, LATERAL name(path, content)``."""

    class Analyzer:
        def eval(self, path: str, content: str):
            yield from fn(path, content)

    spark.udtf.register(name, F.udtf(Analyzer, returnType=DIAGNOSTIC_ROW))


def judge(fn: Callable[[pd.DataFrame], pd.DataFrame]):
    """A judge as an Arrow UDF: batches of findings in, (accepted, confidence, reason) out.

    Apply it to what ``judge_budget`` selected: ``judged.withColumn("verdict", judge(fn)(F.struct(...)))``.
    """
    schema = T.StructType(
        [T.StructField("accepted", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())]
    )

    def run(findings: pd.DataFrame) -> pd.DataFrame:
        return fn(findings)

    return F.pandas_udf(run, returnType=schema)


def token_estimator(fn: Callable[[str], int]) -> Callable[[Column], Column]:
    """A user's token count as an Arrow UDF over a text column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return F.pandas_udf(run, returnType=T.LongType())
