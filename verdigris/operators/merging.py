"""Merging duplicate findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import normalize_evidence

IDENTITY = ["file_id", "rule_id", "_symbol", "_evidence"]
NO_SYMBOL = "\x00"


def union_findings(static: DataFrame, model: DataFrame) -> DataFrame:
    """Static and model findings together, static ones ranked first."""
    return static.withColumn("source_rank", F.lit(0)).unionByName(model.withColumn("source_rank", F.lit(1)))


def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding per problem, with a ``deduplicated`` flag.

    Two findings are the same problem when file, rule, symbol and normalized evidence agree and their spans
    overlap. Findings are taken in order, static ones first, then by start, column and id; each is compared
    with the survivors so far, not with their whole history. A static survivor stays, a model survivor is
    replaced by the newer finding.

    The ordered fold is decomposed so that nothing of a hot identity sits in one row, and works on ids and spans
    only; the full findings are joined back once at the end (``finding_id`` is unique):

    * Static: of equal starts only the first can survive, so a map-side aggregate leaves at most one row per
      start line. Survivors never overlap, hence one streaming pass over those rows in order only holds the last survivor.
    * Model findings next to static survivors: those are disjoint, so the first survivor a finding can hit is
      the one with the smallest end at or after its start. One window finds it.
    * Model findings among themselves: starts only grow, so only the latest survivor can still be hit. Every
      remaining finding becomes that survivor, and it survives unless its successor starts inside it.
    """
    keyed = findings.select(
        "file_id", "rule_id", F.coalesce("symbol", F.lit(NO_SYMBOL)).alias("_symbol"),
        F.sha2(normalize_evidence("evidence"), 256).alias("_evidence"), "source", "start_line", "end_line", "start_column", "finding_id",
    )
    kept = _static_survivors(keyed)
    model = (
        keyed.where("source <> 'static'")
        .groupBy(*IDENTITY, "start_line", "end_line")
        .agg(
            F.max(F.struct("start_column", "finding_id")).alias("_last"),
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    place = lambda df, position, side: df.withColumns({"_position": position, "_side": F.lit(side)})
    both = place(kept, F.col("end_line"), 1).unionByName(place(model, F.col("start_line"), 0), allowMissingColumns=True)
    downwards = Window.partitionBy(*IDENTITY).orderBy(F.desc("_position"), F.desc("_side"))
    nearest = F.last(
        F.when(F.col("_side") == 1, F.col("start_line")), ignorenulls=True
    ).over(downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_nearest", nearest).withColumn(
        "_absorbed", (F.col("_side") == 0) & F.coalesce(F.col("_nearest") <= F.col("end_line"), F.lit(False))
    )
    return findings.join(_survivors(met), "finding_id").select(*findings.columns, "deduplicated")


def _static_survivors(keyed: DataFrame) -> DataFrame:
    first = (
        keyed.where("source = 'static'")
        .groupBy(*IDENTITY, "start_line")
        .agg(
            F.min(F.struct("start_column", "finding_id", "end_line")).alias("_first"),
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    ordered = first.select(
        *IDENTITY, "start_line", F.col("_first.end_line").alias("end_line"), (F.col("_copies") > 1).alias("_flag"),
        F.col("_first.finding_id").alias("_static_id"),
    )
    names = ordered.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the last survivor; it is passed on, with its final flag, once the next one is known."""
        last: list | None = None
        kind = None
        for batch in batches:
            kind = batch.schema
            done: list[list] = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if last is not None and tuple(last[:width]) == row[:width] and last[end] is not None and last[end] >= row[start]:
                    last[flag] = True
                    continue
                if last is not None:
                    done.append(last)
                last = list(row)
            yield rows(done, kind)
        if last is not None:
            yield rows([last], kind)

    def rows(done: list[list], kind: pa.Schema) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in kind]
        return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(columns, kind, strict=True)], schema=kind)

    width, start, end, flag = len(IDENTITY), names.index("start_line"), names.index("end_line"), names.index("_flag")
    return ordered.repartition(*IDENTITY).sortWithinPartitions(*IDENTITY, "start_line").mapInArrow(walk, ordered.schema)


def _survivors(met: DataFrame) -> DataFrame:
    """Static survivors with their final flag, and the model findings that survive, in one pass.

    Every window is partitioned by the identity and more, so all of them share the shuffle by identity.
    """
    is_static, is_model = F.col("_side") == 1, (F.col("_side") == 0) & ~F.col("_absorbed")
    group = F.when(is_static, F.col("start_line")).when(F.col("_absorbed"), F.col("_nearest"))
    hit = F.max("_absorbed").over(Window.partitionBy(*IDENTITY, group))
    same_start = Window.partitionBy(*IDENTITY, is_model, "start_line")
    final = is_model & (F.row_number().over(same_start.orderBy(F.desc("_last"))) == 1)
    chain = Window.partitionBy(*IDENTITY, "_final").orderBy("start_line")
    linked = (
        met.withColumns({"_hit": hit, "_final": final, "_all_copies": F.sum("_copies").over(same_start)})
        .withColumns({"_next": F.lead("start_line").over(chain), "_reached": F.lag("end_line").over(chain)})
        .where(is_static | (F.col("_final") & (F.col("_next").isNull() | (F.col("_next") > F.col("end_line")))))
    )
    replaced = (F.col("_all_copies") > 1) | F.coalesce(F.col("_reached") >= F.col("start_line"), F.lit(False))
    kept = F.when(is_static, F.col("_static_id")).otherwise(F.col("_last.finding_id"))
    flagged = F.when(is_static, F.col("_flag") | F.col("_hit")).otherwise(replaced)
    return linked.select(kept.alias("finding_id"), flagged.alias("deduplicated"))
