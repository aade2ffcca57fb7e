"""Deletions leave the rows that stay where they are."""

from pyspark.sql import functions as F

from verdigris.operators import governance
from verdigris.operators.sifting import without
from verdigris.session import scratch_path
from verdigris.sinks.keyed import KeyedTable


def test_rows_that_stay_are_not_shuffled(spark):
    """Even where the doomed reviews are too many to be sent to every task."""
    rows = spark.range(4000).select((F.col("id") % 1000).alias("review_id"), F.col("id").alias("n"))
    held = scratch_path(spark, "rows")
    rows.write.parquet(held)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = governance.cascade_delete({"findings": spark.read.parquet(held)}, spark.range(0, 1000, 10).select(F.col("id").alias("review_id")))["findings"]
        kept = {row["n"] for row in left.collect()}
        plan = left._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == {at for at in range(4000) if at % 1000 % 10}
    first = plan.splitlines()[0]
    assert "Union" in first and plan.count("LeftAnti") == 1, plan


def test_without_nulls_types_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d"), (3, None)], "id int, of string")
    texts = lambda frame: sorted(str(row["of"]) for row in frame.collect())
    for kind in ("int", "long"):
        keys = spark.createDataFrame([(1,), (1,), (None,), (9,)], f"id {kind}")
        assert texts(without(df, keys, ["id"])) == ["None", "b", "c"]
    assert texts(without(df, spark.createDataFrame([], "id int"), ["id"])) == ["None", "a", "b", "c", "d"]
    assert without(df, spark.createDataFrame([("b",)], "of string"), ["of"]).columns == ["id", "of"]


def test_a_single_load_is_read_and_cut_without_ranking(spark):
    schema = spark.createDataFrame([], "review_id long, name string, at long").schema
    held = KeyedTable(spark, scratch_path(spark, "keyed"), schema, ["review_id", "name"], ["at"], buckets=4, bucket_by=["review_id"])
    held.upsert(spark.range(4000).select((F.col("id") % 500).alias("review_id"), F.col("id").cast("string").alias("name"), F.col("id").alias("at")))
    files = held.read().select(F.input_file_name().alias("f")).distinct().count()
    slices = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    assert files <= 4 * slices
    assert "Window" not in held.read().where("at >= 0")._jdf.queryExecution().optimizedPlan().toString()
    held.delete(spark.range(0, 500, 5).select(F.col("id").alias("review_id")))
    assert {row["at"] for row in held.read().collect()} == {at for at in range(4000) if at % 500 % 5}
    # Many rows of the same keys take the other way in, and meet what is there.
    held.upsert(spark.range(4000).select(F.lit(1).cast("long").alias("review_id"), (F.col("id") % 3).cast("string").alias("name"), (F.col("id") + 10_000).alias("at")))
    assert held.read().where("at >= 10000").count() == 3 and held.read().count() == 3202  # one of the names was there
