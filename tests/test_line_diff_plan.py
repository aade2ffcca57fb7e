"""Tables of line numbers grow with the texts but take little room in files: none of them is sent to every task."""

from verdigris.operators import line_diff
from verdigris.plans.catalog import QUERIES


def test_no_table_is_sent_to_every_task(spark, monkeypatch):
    old = spark.createDataFrame([(at, "a\nb\nc\na") for at in range(20)], "file_id long, content string")
    new = spark.createDataFrame([(at, f"a\nc\n{at}\na") for at in range(20)], "file_id long, content string")
    plans, settle = [], line_diff.settle
    monkeypatch.setattr(line_diff, "settle", lambda df, *name: plans.append(df) or settle(df, *name))
    changes = line_diff.revision_line_changes(old, new)
    assert sorted(map(tuple, changes.collect())) == [(at, 2, 3) for at in range(20)]
    text = "".join(df._jdf.queryExecution().executedPlan().toString() for df in (*plans, changes))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_texts_without_lines(spark, tmp_path):
    texts = ["a\nb", "", "", "c", "", "", "x\ny", None, None]
    rows = [(at, text, "en", "src1", 0) for at, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, QUERIES["revision_line_changes"](spark, str(tmp_path)).collect()))
    # Even files get a line more; a file without lines has none to lose or change.
    assert found == [(0, 3, 3), (2, 1, 1), (4, 1, 1), (6, 3, 3)]
