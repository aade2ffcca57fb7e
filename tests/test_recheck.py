"""Fingerprints of one table meet where they lie: the same states and findings as by joins, without settling or shuffling them."""

import random

from pyspark.sql import functions as F

from test_gate_parts import tables

from verdigris.operators import joins
from verdigris.plans.catalog import QUERIES


def anchors(spark):
    dice = random.Random(6)
    rows = [
        (dice.choice([1, 2, 3]), dice.choice(["r", "s", None]), f"x{dice.randrange(40)}", dice.choice(["static", "llm"]), dice.choice(["low", None]))
        for _ in range(300)
    ]
    frame = spark.createDataFrame(rows, "file_id int, review_id string, finding_id string, source string, severity string")
    mark = F.when(F.col("finding_id") != "x7", F.concat("file_id", F.lit("/"), F.pmod(F.xxhash64("finding_id"), F.lit(9))))
    return frame.withColumn("fingerprint", mark).cache()


def test_states_by_condition_and_by_table(spark):
    rows = anchors(spark)
    fixed, current = rows.where("source = 'static'"), rows.where("source = 'llm'")
    seen = lambda one, other: one.join(other.select("review_id", "fingerprint").distinct().withColumn("_seen", F.lit(True)), ["review_id", "fingerprint"], "left")
    want = []
    for one, other, otherwise in ((fixed, current, "fixed_verified"), (current, fixed, "active")):
        again = seen(one, other).groupBy("review_id", "finding_id").agg(F.max(F.coalesce("_seen", F.lit(False))).alias("again"))
        want += [(row["review_id"], row["finding_id"], "reopened" if row["again"] else otherwise) for row in again.collect()]
    want.sort(key=repr)
    assert {state for _, _, state in want} == {"reopened", "fixed_verified", "active"}
    for found in (joins.reopen_fixed(fixed, current), joins.reopen_fixed(rows, F.col("source") == "llm", ("file_id",))):
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert "Join" not in joins.reopen_fixed(rows, F.col("source") == "llm", ("file_id",))._jdf.queryExecution().optimizedPlan().toString()


def test_hidden_by_condition_and_by_table(spark):
    rows = anchors(spark)
    ignored = "source = 'llm' AND severity = 'low'"
    findings = rows.select("finding_id")
    want = sorted(map(tuple, joins.suppress_ignored(findings, rows, rows.where(ignored)).collect()))
    assert sorted(map(tuple, joins.suppress_ignored(findings, rows, F.expr(ignored), ("file_id",)).collect())) == want and want


def test_anchors_that_lie_by_file_are_not_shuffled(spark, tmp_path):
    tables(spark, tmp_path, range(60))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, most in (("reopen_fixed", 5), ("suppress_ignored", 8)):
            plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert len(exchanges) <= most and not any("fingerprint" in line or "_block" in line for line in exchanges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
