"""What the training-data operators shuffle, told by their plans."""

import pytest
from pyspark.sql import functions as F

from verdigris.llm import ngram_lm


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_language_model_shuffles_answers_not_blocks(spark, no_broadcasts):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two"), F.col("id").cast("string")).alias("text"))
    scored = ngram_lm.score(docs, F.col("doc_id") % 5 == 1, tokens_per_block=20, entries_per_shard=50)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 2  # the counts and the answers
    assert scored.count() == 40
    assert not [one.name for one in spark.catalog.listTables() if one.name.startswith("settled_")]
