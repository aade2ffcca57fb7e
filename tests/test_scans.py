"""Scans and sums that come together from parts."""

import random

from pyspark.sql import functions as F

from verdigris.operators import circuit, digests


def test_streaks_over_very_many_slices(spark):
    """Slices of a second over years, so that the tree has several levels; one endpoint holds most of the log."""
    dice = random.Random(8)
    rows, now = [], -40_000_000
    for at in range(3000):
        now += dice.choice([1, 1, 2, 20, 31, 32, 40_000, 300_000])
        rows.append((1 if dice.random() < 0.8 else dice.randrange(2, 5), at, now, dice.choice(["failed", "failed", "failed", "neutral", "ok"])))
    attempts = spark.createDataFrame(rows, "endpoint int, attempt_id int, at long, outcome string").withColumn("started_at", F.timestamp_seconds("at"))
    found = circuit.failure_streaks(attempts, slice_seconds=1)
    got = {row["attempt_id"]: (row["streak"], row["circuit_open"]) for row in found.collect()}
    states = {}
    for endpoint, attempt, at, outcome in rows:
        state = circuit.after_attempt(*states.get(endpoint, (0, None)), at * 1_000_000, outcome, circuit.FAILURE_THRESHOLD, circuit.COOLDOWN_SECONDS * 1_000_000)
        states[endpoint] = state
        assert got[attempt] == (state[0], state[1] is not None)
    assert circuit.failure_streaks(attempts.limit(0)).count() == 0


def test_long_streak_through_many_slices(spark):
    rows = [(1, at, at * 10, "failed") for at in range(500)] + [(1, 500, 5000, "neutral"), (1, 501, 5010, "failed")]
    attempts = spark.createDataFrame(rows, "endpoint int, attempt_id int, at long, outcome string").withColumn("started_at", F.timestamp_seconds("at"))
    got = {row["attempt_id"]: row["streak"] for row in circuit.failure_streaks(attempts, slice_seconds=25).collect()}
    assert all(got[at] == at + 1 for at in range(500)) and got[500] == 500 and got[501] == 501


def test_digest_adds(spark):
    items = [("a", f"i{at}") for at in range(50)] + [("a", "i1"), ("b", "x"), ("b", None)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, item string")
    of = lambda rows: {row["k"]: row["digest"] for row in digests.set_digest(frame(rows), ["k"], F.col("item")).collect()}
    whole = of(items)
    assert set(whole) == {"a", "b"} and whole == of(items[::-1]) and whole["b"] == of([("b", "x")])["b"]
    assert whole["a"] != of([*items, ("a", "i1")])["a"] and whole["a"] != of(items[1:])["a"] and whole["a"] != of([("a", "i2x"), *items[1:]])["a"]
    # A change is the new state less what fell away, without reading the rest again.
    old = digests.lane_sums(frame(items), ["k"], F.col("item"))
    gone = digests.lane_sums(frame([("a", "i7"), ("b", "x")]), ["k"], F.col("item"))
    new = digests.lane_sums(frame([("a", "new")]), ["k"], F.col("item"))
    less = gone.select("k", *[(-F.col(name)).cast(kind).alias(name) for name, kind in gone.dtypes if name != "k"])
    merged = digests.finished(digests.merged_sums(old.unionByName(new).unionByName(less), ["k"]), ["k"])
    left = [item for item in items if item not in (("a", "i7"), ("b", "x"))] + [("a", "new")]
    assert {row["k"]: row["digest"] for row in merged.collect()} == of([item for item in left if item[1] is not None])
