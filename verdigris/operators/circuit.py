"""Failure streaks and circuit state of endpoints, over a log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.running import time_slice
from verdigris.session import settle

# Failures in a row that open a circuit, and how long it stays open.
FAILURE_THRESHOLD = 3
COOLDOWN_SECONDS = 30


def after_attempt(
    streak: int, opened: int | None, at: int, outcome: str, threshold: int, cooldown: int
) -> tuple[int, int | None]:
    """Streak and opening time (microseconds) after one attempt."""
    if opened is not None and at - opened > cooldown:
        streak, opened = 0, None
    if outcome == "ok":
        return 0, None
    if outcome == "failed":
        streak += 1
        opened = at if streak >= threshold else None
    return streak, opened


#: Slices, or groups of slices, that one node of the tree puts together.
FAN = 64


def _after(ends: Column, carries: Column, streak: Column, threshold: int) -> Column:
    """Streak at the end of a slice that begins with ``streak``."""
    longer = F.when(carries & (streak > threshold), streak - threshold).otherwise(0)
    return F.element_at(ends, F.least(streak, F.lit(threshold)) + 1) + longer


def _starts(transitions: DataFrame, threshold: int) -> DataFrame:
    """``endpoint``, ``slice``, ``start``: the streak with which each slice begins.

    What slices do to a streak composes, and the result has the same few numbers. So groups of ``FAN`` consecutive slices
    become one, and groups of groups, up to one per endpoint; from there the starts come down again. The tree is as deep
    as the logarithm of the time span, and each of its nodes is a row.
    """
    first, last = transitions.agg(F.min("slice"), F.max("slice")).first()
    step = F.struct(F.col("part"), F.col("ends"), F.col("carries"))
    levels = [transitions.select("endpoint", (F.col("slice") - F.lit(first or 0)).alias("part"), "ends", "carries")]
    span = (last or 0) - (first or 0) + 1
    unchanged = F.sequence(F.lit(0), F.lit(threshold))

    def then(before: Column, one: Column) -> Column:
        ends = F.transform(before["ends"], lambda streak: _after(one["ends"], one["carries"], streak, threshold))
        return F.struct(ends.alias("ends"), (before["carries"] & one["carries"]).alias("carries"))

    while span > 1:
        groups = levels[-1].groupBy("endpoint", F.floor(F.col("part") / FAN).alias("part")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
        whole = F.aggregate("steps", F.struct(unchanged.alias("ends"), F.lit(True).alias("carries")), then)
        levels.append(settle(groups.withColumn("whole", whole).select("endpoint", "part", "steps", "whole.ends", "whole.carries"), "slice-groups"))
        span = -(-span // FAN)
    starts = levels[-1].select("endpoint", "part", F.lit(0).alias("start"))
    for level in levels[:0:-1]:
        # A node has FAN steps at most, so the list that grows here is short.
        run = F.aggregate(
            "steps", F.struct(F.col("start").alias("streak"), F.array().cast("array<struct<part:bigint,start:int>>").alias("done")),
            lambda held, one: F.struct(
                _after(one["ends"], one["carries"], held["streak"], threshold).alias("streak"),
                F.array_append(held["done"], F.struct(one["part"].alias("part"), held["streak"].alias("start"))).alias("done"),
            ),
        )
        below = level.join(starts, ["endpoint", "part"]).select("endpoint", F.explode(run["done"]).alias("one"))
        starts = below.select("endpoint", "one.part", "one.start")
    return starts.select("endpoint", (F.col("part") + F.lit(first or 0)).alias("slice"), "start")


def failure_streaks(
    attempts: DataFrame,
    threshold: int = FAILURE_THRESHOLD,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Add ``streak`` and ``circuit_open`` after each attempt of an endpoint.

    Failures add up, a success clears them, ``outcome = 'neutral'`` changes nothing; at ``threshold`` the
    circuit opens, and the first attempt later than the cooldown after the last failure finds it closed.

    An endpoint may hold most of the log, so it is worked in time slices: each slice reports where it ends
    for every start up to the threshold (and whether a longer streak runs through), a tree over the slices
    composes these reports, then each slice is replayed from its known start. A partition streams its slices in
    order and keeps only the state of the current one. ``attempts``: endpoint, attempt_id, started_at, outcome (ok, failed, neutral).
    """
    cooldown = cooldown_seconds * 1_000_000
    columns = ["endpoint", "slice", "at", "outcome"]

    def walk(batch: pd.DataFrame, *more: str) -> Iterator[tuple]:
        before = [None if pd.isna(value) else int(value) for value in batch["last_failure"].tolist()]
        return zip(*[batch[name].tolist() for name in columns], before, *[batch[name].tolist() for name in more])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["endpoint", "slice", "ends", "carries"]
        key, states, lowest, failures = None, [], 0, 0

        def report() -> tuple:
            results = [state[0] for state in states]
            return (*key, results, lowest >= threshold and results[-1] == threshold + failures)

        for batch in batches:
            done = []
            for endpoint, part, at, outcome, before in walk(batch):
                if (endpoint, part) != key:
                    if key is not None:
                        done.append(report())
                    key, lowest, failures = (endpoint, part), threshold, 0
                    states = [(start, before if start >= threshold else None) for start in range(threshold + 1)]
                states = [after_attempt(*state, at, outcome, threshold, cooldown) for state in states]
                lowest = min(lowest, states[-1][0])
                failures += outcome == "failed"
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([report()], columns=names)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (0, None)
        for batch in batches:
            streaks, opened = [], []
            for endpoint, part, at, outcome, before, start in walk(batch, "start"):
                if (endpoint, part) != key:
                    key, state = (endpoint, part), (start, before if start >= threshold else None)
                state = after_attempt(*state, at, outcome, threshold, cooldown)
                streaks.append(state[0])
                opened.append(state[1] is not None)
            yield batch[["endpoint", "attempt_id"]].assign(streak=streaks, circuit_open=opened)

    rows = attempts.select(
        "endpoint", "attempt_id", F.unix_micros("started_at").alias("at"), "outcome",
        time_slice(F.col("started_at"), slice_seconds).alias("slice"),
    )
    slices = rows.groupBy("endpoint", "slice").agg(F.max(F.when(F.col("outcome") == "failed", F.col("at"))).alias("_failure"))
    earlier = Window.partitionBy("endpoint").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    known = slices.select("endpoint", "slice", F.max("_failure").over(earlier).alias("last_failure"))
    in_order = lambda df: df.repartition("endpoint", "slice").sortWithinPartitions("endpoint", "slice", "at", "attempt_id")
    placed = rows.join(known, ["endpoint", "slice"])
    endpoint_type = dict(attempts.dtypes)["endpoint"]
    transitions = in_order(placed).mapInPandas(ends, f"endpoint {endpoint_type}, slice bigint, ends array<int>, carries boolean")
    begin = _starts(settle(transitions, "slice-transitions"), threshold)
    return in_order(placed.join(begin, ["endpoint", "slice"])).mapInPandas(
        label, f"endpoint {endpoint_type}, attempt_id bigint, streak int, circuit_open boolean"
    )
