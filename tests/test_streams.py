import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.session import scratch_path, shared_folder
from verdigris.streaming import runs, stateful, windowed

SCHEMA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("key", "sequence", "at")]
    + [T.StructField("ts", T.TimestampType()), T.StructField("what", T.StringType()), T.StructField("number", T.LongType())]
)


def write_files(spark, folder, rows, parts):
    """Rows in order, as one file per part; the names keep the order of arrival."""
    size = -(-len(rows) // parts)
    for at in range(parts):
        piece = rows[at * size : (at + 1) * size]
        df = spark.createDataFrame(piece, "key bigint, sequence bigint, at bigint, what string, number bigint").select(
            "key", "sequence", "at", F.timestamp_micros("at").alias("ts"), "what", "number"
        )
        df.coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, files_per_trigger=None):
    return runs.read_stream(spark, folder, SCHEMA, files_per_trigger)


def sample(seed, whats, count=240, gap=20):
    rng = random.Random(seed)
    at, rows = 1_700_000_000_000_000, []
    for sequence in range(count):
        at += rng.randint(1, gap) * 1_000_000
        rows.append((1 if rng.random() < 0.5 else rng.randint(2, 4), sequence, at, rng.choice(whats), rng.randint(1, 3)))
    return rows


JOBS = {
    "machine": (
        list(stateful.REVIEW_MOVES),
        lambda s: stateful.review_state_machine(s.select(F.col("key").alias("review_id"), "sequence", "at", F.col("what").alias("to_status"))),
    ),
    "lifecycle": (
        [name for name in stateful.FINDING_ACTIONS if name != "found_again"],
        lambda s: stateful.finding_lifecycle(s.select(F.col("key").alias("review_id"), F.col("number").alias("finding_id"), "sequence", "at", F.col("what").alias("action"))),
    ),
    "stale": (
        ["start", "result", "result", "stop"],
        lambda s: stateful.drop_stale_attempts(s.select(F.col("key").alias("review_id"), "sequence", "at", F.col("what").alias("kind"), F.col("number").alias("attempt"))),
    ),
    "limit": (
        ["fail", "fail", "fail", "good"],
        lambda s: stateful.stream_rate_limit(
            s.select(F.col("key").cast("string").alias("username"), F.lit(1).cast("long").alias("source"), "sequence", "at", (F.col("what") == "good").alias("succeeded")), 3, 60
        ),
    ),
    "circuit": (
        ["failed", "failed", "ok", "neutral"],
        lambda s: stateful.stream_circuit(s.select(F.col("key").alias("endpoint"), "sequence", "at", F.col("what").alias("outcome"))),
    ),
}


@pytest.mark.parametrize("name", list(JOBS))
def test_one_batch_or_many_give_the_same(spark, name):
    whats, job = JOBS[name]
    folder = scratch_path(spark, "in")
    write_files(spark, folder, sample(name, whats), 3)
    at_once = runs.append_all(job(source(spark, folder)), name)
    in_steps = runs.append_all(job(source(spark, folder, 1)), name)
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, in_steps.collect()))
    assert at_once.count() > 0


def shuffled(seed, rows, reach):
    """Rows out of order, none of them behind one that is more than ``reach`` seconds younger."""
    dice = random.Random(seed)
    return sorted(rows, key=lambda row: row[2] + dice.randrange(reach * 1_000_000))


LATE_JOBS = {
    "machine": lambda s, late: stateful.review_state_machine(s.select(F.col("key").alias("review_id"), "sequence", "at", "ts", F.col("what").alias("to_status")), late),
    "lifecycle": lambda s, late: stateful.finding_lifecycle(
        s.select(F.col("key").alias("review_id"), F.col("number").alias("finding_id"), "sequence", "at", "ts", F.col("what").alias("action")), late
    ),
    "stale": lambda s, late: stateful.drop_stale_attempts(
        s.select(F.col("key").alias("review_id"), "sequence", "at", "ts", F.col("what").alias("kind"), F.col("number").alias("attempt")), late
    ),
    "limit": lambda s, late: stateful.stream_rate_limit(
        s.select(F.col("key").cast("string").alias("username"), F.lit(1).cast("long").alias("source"), "sequence", "at", "ts", (F.col("what") == "good").alias("succeeded")),
        3, 60, late,
    ),
    "circuit": lambda s, late: stateful.stream_circuit(s.select(F.col("key").alias("endpoint"), "sequence", "at", "ts", F.col("what").alias("outcome")), lateness=late),
}


@pytest.mark.parametrize("name", list(LATE_JOBS))
def test_any_order_over_batches_gives_the_same(spark, name):
    whats, job = JOBS[name][0], LATE_JOBS[name]
    rows = sample(name, whats)
    # A last row far ahead moves the watermark behind all others.
    end = (9, 999, rows[-1][2] + 86_400_000_000, whats[0], 1)
    ordered, dealt = scratch_path(spark, "in"), scratch_path(spark, "in")
    write_files(spark, ordered, [*rows, end], 1)
    write_files(spark, dealt, [*shuffled(name, rows, 300), end], 6)
    want = [tuple(row) for row in runs.append_all(JOBS[name][1](source(spark, ordered)), name).collect() if row["sequence"] != 999]
    got = runs.append_all(job(source(spark, dealt, 1), "10 minutes"), name).collect()
    assert sorted((*row, False) for row in want) == sorted(tuple(row) for row in got if row["sequence"] != 999)


def test_late_rows_are_told_apart(spark):
    second, base = 1_000_000, 1_700_000_000 * 1_000_000
    rows = [(1, at, base + at * 60 * second, "failed", 1) for at in range(30)]
    late = [(1, 100, base + 30 * second, "ok", 1), (2, 101, base + 30 * second, "ok", 1)]
    end = [(9, 999, base + 86_400 * second, "ok", 1)]
    folder = scratch_path(spark, "in")
    write_files(spark, folder, rows[:20], 1)
    write_files(spark, folder, rows[20:], 1)
    write_files(spark, folder, late, 1)
    write_files(spark, folder, end, 1)
    got = runs.append_all(LATE_JOBS["circuit"](source(spark, folder, 1), "5 minutes"), "late").collect()
    known = {row["sequence"]: row for row in got}
    # Key 1 was applied beyond the late row, which changes nothing; key 2 has nothing applied yet and takes it.
    assert [row["sequence"] for row in got if row["late"]] == [100] and known[100]["endpoint"] == 1 and known[100]["streak"] is None
    assert not known[101]["late"]
    streak, opened = 0, None
    for row in rows:
        streak, opened = stateful.after_attempt(streak, opened, row[2], row[3], stateful.FAILURE_THRESHOLD, stateful.COOLDOWN_SECONDS * 1_000_000)
        assert known[row[1]]["streak"] == streak


def test_deadlines_in_any_order(spark):
    second, base = 1_000_000, 1_700_000_000 * 1_000_000
    dice = random.Random(3)
    rows = []
    for key in range(1, 8):
        at = base
        for turn in range(12):
            at += dice.randrange(1, 90) * second
            rows.append((key, 100 * key + turn, at, dice.choice(["start", "start", "finish"]), 0))
    end = [(99, 9999, base + 86_400 * second, "finish", 0)]
    got = {}
    for name, dealt, parts in (("one", sorted(rows, key=lambda row: row[2]), 1), ("many", shuffled(1, rows, 200), 5)):
        folder = scratch_path(spark, "in")
        write_files(spark, folder, [*dealt, *end], parts)
        stream = source(spark, folder, 1).select(F.col("key").alias("review_id"), "sequence", "at", "ts", F.col("what").alias("kind"))
        got[name] = sorted(map(tuple, runs.append_all(stateful.deadline_monitor(stream, 60, "10 minutes"), name).collect()))
    want = []
    for key in range(1, 8):
        own = sorted((row for row in rows if row[0] == key), key=lambda row: row[2])
        for row, after in zip(own, [*own[1:], None]):
            if row[3] == "start" and (after is None or after[2] > row[2] + 60 * second):
                want.append((key, row[1], row[2] + 60 * second, False))
    assert got["one"] == got["many"] == sorted(want)


def test_restart_repeats_nothing(spark):
    folder, target, checkpoint = (scratch_path(spark, name) for name in ("in", "out", "checkpoint"))
    rows = sample(5, ["failed", "ok"])
    write_files(spark, folder, rows[:100], 1)
    job = lambda: JOBS["circuit"][1](source(spark, folder))
    assert runs.append_all(job(), "c", checkpoint, target).count() == 100
    assert runs.append_all(job(), "c", checkpoint, target).count() == 100
    write_files(spark, folder, rows[100:], 1)
    got = runs.append_all(job(), "c", checkpoint, target)
    whole = scratch_path(spark, "in")
    write_files(spark, whole, rows, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs.append_all(JOBS["circuit"][1](source(spark, whole)), "c").collect()))


def test_deadline_fires_once(spark):
    second = 1_000_000
    base = 1_700_000_000 * second
    rows = [
        (1, 0, base, "start", 0), (1, 1, base + 30 * second, "finish", 0),  # in time
        (2, 2, base, "start", 0), (2, 3, base + 90 * second, "finish", 0),  # late
        (3, 4, base, "start", 0),  # never
        (4, 5, base + 7200 * second, "finish", 0),  # moves the watermark
        (5, 6, base + 7200 * second, "start", 0),  # still running
    ]
    folder = scratch_path(spark, "in")
    write_files(spark, folder, rows, 1)
    stream = source(spark, folder).withWatermark("ts", "10 minutes").select(F.col("key").alias("review_id"), "sequence", "at", "ts", F.col("what").alias("kind"))
    got = runs.append_all(stateful.deadline_monitor(stream), "deadline")
    assert sorted((row.review_id, row.sequence, row.expired_at - base) for row in got.collect()) == [(2, 2, 60 * second), (3, 4, 60 * second)]


def test_upsert_replay_changes_nothing(spark):
    target = scratch_path(spark, "upsert")
    write = runs.upsert_batches(target)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "key int, value string")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(1, "c")], "key int, value string"), 1)
    assert spark.read.parquet(target).count() == 3


def test_live_progress_in_steps(spark):
    folder = scratch_path(spark, "in")
    write_files(spark, folder, sample(9, ["completed", "failed", "running", "pending", "superseded"]), 3)
    progress = windowed.live_progress(source(spark, folder, 1).select(F.col("key").alias("review_id"), F.col("what").alias("status")))
    got = runs.upsert_all(progress, "progress", ["review_id"], ["total"], output_mode="update")
    want = windowed.live_progress(spark.read.schema(SCHEMA).parquet(folder).select(F.col("key").alias("review_id"), F.col("what").alias("status")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_folder_comes_from_the_session():
    assert shared_folder(Session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    assert scratch_path(Session("hdfs://x/y", "yarn"), "z").startswith("hdfs://x/y/z-")
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"))
    assert shared_folder(Session(None, "local[2]")) == shared_folder(Session(None, "local[2]"))


def test_waiting_rows_cost_calls_by_the_block(spark):
    """Rows that wait lie in sorted blocks, come back in event order whatever overlaps, and are split where the watermark falls."""

    class Map(dict):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def containsKey(self, key):
            return key in self

        def removeKey(self, key):
            del self[key]

    machine = stateful.ReviewMachine()
    machine.blocks = Map()
    dice = random.Random(1)
    rows = [{"at": dice.randrange(10**9), "sequence": at, "to_status": "x"} for at in range(5000)] + [{"at": 7, "sequence": 1, "to_status": "x"}] * 600
    dice.shuffle(rows)
    for start in range(0, len(rows), 1000):
        assert list(machine._put((1,), pd.DataFrame(rows[start : start + 1000]), None)) == []
    assert machine.blocks.calls < 40
    moments = sorted((row["at"], row["sequence"]) for row in rows)
    got = []
    for end in (7, 8, 10**8, 10**8 + 1, 9 * 10**8, None):
        part = [(row["at"], row["sequence"]) for row in machine._waiting(end)]
        assert end is None or all(at < end for at, _ in part)
        got += part
    assert got == moments and not machine.blocks and machine.blocks.calls < 200
