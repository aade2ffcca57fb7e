"""The keyed table: replays, compaction, deletion, writers that die."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.session import scratch_path
from verdigris.sinks.keyed import KeyedTable

SCHEMA = "review_id long, name string, at long, value string"


def table(spark, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return KeyedTable(spark, scratch_path(spark, "keyed"), schema, ["review_id", "name"], ["at", "value"], **{"buckets": 8, **more})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("by_arrival, max_deltas", [(False, 2), (True, 3)])
def test_same_as_a_dictionary(spark, by_arrival, max_deltas):
    dice = random.Random(max_deltas)
    held = table(spark, by_arrival=by_arrival, max_deltas=max_deltas, bucket_by=["review_id"])
    want = {}
    assert held.read().count() == 0 and held.version() == 0
    for batch in range(6):
        rows = [(dice.randrange(20) or None, dice.choice("ab"), dice.randrange(50), f"{batch}") for _ in range(30)]
        newest = {}
        for row in rows:
            newest[row[:2]] = max(newest.get(row[:2], row), row, key=lambda one: one[2:])
        for key, row in newest.items():
            if by_arrival or key not in want or row[2:] >= want[key][2:]:
                want[key] = row
        changes = spark.createDataFrame(rows, SCHEMA)
        assert held.upsert(changes, batch, "w") and not held.upsert(changes, batch, "w")
        assert rows_of(held.read()) == sorted(want.values(), key=str)
        open_ones = [one.bucket for one in held.entries() if one.kind == "delta"]
        assert all(open_ones.count(bucket) <= max_deltas for bucket in open_ones)
        if batch == 3:
            doomed = [4, 7]
            before = {one.load for one in held.entries() if one.load}
            touched = held.delete(spark.createDataFrame([(one,) for one in doomed], "review_id long"))
            assert 1 <= len(touched) <= 2
            new = {(one.bucket, one.load) for one in held.entries() if one.load and one.load not in before}
            assert {bucket for bucket, _ in new} <= set(touched)
            want = {key: row for key, row in want.items() if key[0] not in doomed}
            assert rows_of(held.read()) == sorted(want.values(), key=str)
    held.compact()
    assert all(one.kind != "delta" for one in held.entries()) and rows_of(held.read()) == sorted(want.values(), key=str)
    assert held.compact() == [] and len(held.delete(spark.createDataFrame([(999,)], "review_id long"))) <= 1
    assert held.vacuum() > 0 and rows_of(held.read()) == sorted(want.values(), key=str)


def test_versions_stay_readable_when_a_writer_dies(spark):
    held = table(spark)
    held.upsert(spark.createDataFrame([(1, "a", 1, "x")], SCHEMA))
    before = rows_of(held.read())
    # Data without a version, and a version that was never completed.
    held._write(spark.createDataFrame([(1, "a", 9, "lost")], SCHEMA), 2)
    spark.range(1).write.parquet(f"{held.path}/log/version=7/_temporary/0")
    assert held.version() == 1 and rows_of(held.read()) == before
    held.upsert(spark.createDataFrame([(1, "a", 2, "y"), (2, "b", 1, "z")], SCHEMA))
    assert rows_of(held.read()) == [(1, "a", 2, "y"), (2, "b", 1, "z")] and rows_of(held.read(1)) == before
    with pytest.raises(Exception, match="(?i)exists"):
        held._commit(2, held.entries())


def test_a_delta_touches_its_buckets_only(spark):
    held = table(spark, buckets=16)
    held.upsert(spark.range(2000).select(F.col("id").alias("review_id"), F.lit("n").alias("name"), F.lit(1).cast("long").alias("at"), F.lit("v").alias("value")))
    held.compact()
    held.upsert(spark.createDataFrame([(5, "n", 2, "w")], SCHEMA))
    deltas = [one for one in held.entries() if one.kind == "delta"]
    assert len(deltas) == 1 and held.read().where("value = 'w'").count() == 1 and held.read().count() == 2000
    # One review goes: one bucket is rewritten, the other fifteen keep their files.
    before = {(one.bucket, one.load) for one in held.entries()}
    touched = held.delete(spark.createDataFrame([(5, "n")], "review_id long, name string"))
    assert len(touched) == 1 and len(before & {(one.bucket, one.load) for one in held.entries()}) == 15
    assert held.read().count() == 1999
