"""Calls are made distinct once, and only those of names that somebody has reach the joins."""

from pyspark.sql import functions as F

from verdigris.operators import aggregates, joins
from verdigris.plans import join_queries
from verdigris.plans.bindings import Tables

SMALLEST = "/root/testdata/sf0.001"


def test_nearest_refs_drops_calls_of_unknown_names_first(spark, monkeypatch):
    held = {}

    def settle(df, name="stage", partition_by=None):
        held.setdefault(name, df)
        return df

    monkeypatch.setattr(joins, "settle", settle)
    symbols = spark.createDataFrame([(1, at, f"f{at}", "p", at) for at in range(6)], "review_id int, symbol_id int, name string, path string, start_line int")
    symbols = symbols.withColumn("file_id", F.col("path"))
    rows = [(1, at % 6, f"lib{at}") for at in range(500)] + [(1, 0, "f3")] * 40 + [(1, 2, "f3"), (2, 2, "f3")]
    calls = spark.createDataFrame(rows, "review_id int, symbol_id int, callee string")
    imports = spark.createDataFrame([], "target_id int, file_id string, path string, start_line int")
    got = joins.nearest_refs(symbols, symbols, calls, imports, 4).collect()
    assert sorted(tuple(row) for row in held["named-calls"].collect()) == [(1, 0, "f3"), (1, 2, "f3")]
    assert {(row["target_id"], row["start_line"], row["rank"]) for row in got} == {(0, 3, 10), (2, 3, 10), (3, 0, 20), (3, 2, 20)}


def test_symbol_degree_makes_calls_distinct_once(spark):
    plan = aggregates.symbol_degree(join_queries.calls(Tables(spark, SMALLEST)))._jdf.queryExecution().sparkPlan().toString()
    on_names = [line for line in plan.splitlines() if "Aggregate(keys=" in line and "callee" in line]
    assert len(on_names) <= 2, plan  # before and after one shuffle
