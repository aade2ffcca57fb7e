"""Drafts meet the parts of their ids by a join only where an id stands more than once."""

import datetime

from verdigris.plans import projection_queries
from verdigris.plans.bindings import Tables
from verdigris.plans.catalog import QUERIES


def tables(spark, folder, orders):
    """Line items in the shape of the given table; an order that is null leaves its ids the same."""
    rows = [
        (order, None if order is None else 1 + at % 3, 10 + at % 4, at % 5, 2.0, 10.0 * (at % 2), 0.05, 0.02, "ANR"[at % 3], "FO"[at % 2], datetime.date(1995, 1, 1))
        for at, order in enumerate(orders)
    ]
    schema = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    )
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    documents = [(at, "one\ntwo consider\nthree\nfour may be", "en", "src1", 9) for at in range(6)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return Tables(spark, str(folder))


def test_single_ids_need_no_join(spark, tmp_path):
    t = tables(spark, tmp_path, range(60))
    plan = QUERIES["gate_drafts_semantic"](spark, t.folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # findings and their files


def test_repeated_ids_stand_with_each_of_their_parts(spark, tmp_path):
    t = tables(spark, tmp_path, [at % 20 if at % 4 else None for at in range(120)])
    drafts = projection_queries.drafts(t)
    want = sorted(map(tuple, drafts.join(t.text_findings.select("finding_id", "part_id"), "finding_id").collect()))
    found = projection_queries.drafts_with_parts(t).select(*drafts.columns, "part_id")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300
