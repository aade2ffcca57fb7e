"""Every stage of the pipeline on its own, and all of them in a row."""

import pytest

import corpus_pipeline
from verdigris.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans string, quality_score string, text_node string"
    prose = "The committee met on a quiet morning and read the long report about rivers, bridges and roads. "
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(1).collect()
    rows = [
        (1, prose * 3, "en", "a", 1), (2, prose * 3, "en", "b", 1), (3, prose * 3 + "End.", "en", "c", 1), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, prose + items[0]["text"] + prose, "en", "a", 1), (7, "my password=hunter2222 stays here, said the man at the door.", "en", "a", 1),
        (None, "A row without an id keeps its place among the others.", "en", "a", 1), (8, "x" * 200_000, "en", "a", 200_000),
        (9, "my password=hunter2222 stays here, said the man at the door.", "en", "b", 1),
    ]
    return spark.createDataFrame([(*row, "s", "q", "n") for row in [*rows, rows[0]]], kind)


def test_each_stage_keeps_columns_and_survives_odd_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, FOLDER).where("not round_trip").count() == 0 and last(spark, docs, FOLDER).count() == docs.count()


def test_decisions(spark, docs):
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).select("doc_id").collect()
    assert sorted((row["doc_id"] for row in kept), key=str) == sorted([1, 4, 6, 7, 8, None], key=str)
    clean = {row["doc_id"] for row in corpus_pipeline.drop_contaminated(spark, docs, FOLDER).collect()}
    assert clean == {1, 2, 3, 4, 5, 7, 8, 9, None}
    masked = {row["doc_id"]: row for row in corpus_pipeline.mask_secrets(spark, docs, FOLDER).collect()}
    assert masked[7]["text"] == "my [SECRET] stays here, said the man at the door." and masked[7]["n_chars"] == len(masked[7]["text"])
    assert masked[1]["text"] == docs.where("doc_id = 1").first()["text"] and masked[1]["n_chars"] == 1 and masked[4]["text"] is None


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    assert rows and all(row["round_trip"] for row in rows)
    junk = {row["doc_id"] for row in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    good = {row["doc_id"] for row in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    kept = {row["doc_id"] for row in corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER).select("doc_id").collect()}
    assert good <= kept and len(kept & junk) <= len(junk) // 2  # few labels at this size
