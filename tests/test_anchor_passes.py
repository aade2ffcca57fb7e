"""Fingerprints of findings are taken once, with the columns that tell both sides of a join apart."""

from pyspark.sql import functions as F

from verdigris.operators import projections


def test_anchors_keep_columns_and_normalize_lines_in_their_file(spark):
    files = spark.createDataFrame([(1, "a.py", "  One\tTWO \nthree\n")], "file_id int, path string, content string")
    rows = [("x", 7, 1, 1, 2, "", "r", "a.py", "llm"), ("y", 7, 1, 1, 1, "one two", "r", "a.py", "static"), ("z", 7, 2, 1, 1, "", "r", None, "llm")]
    findings = spark.createDataFrame(rows, "finding_id string, review_id int, file_id int, start_line int, end_line int, evidence string, rule_id string, path string, source string")
    found = projections.anchor_fingerprints(findings, files, also=("source",))
    want = F.sha2(F.concat_ws("\x1f", F.lit("a.py"), F.lit("r"), F.col("anchor")), 256)
    anchors = spark.createDataFrame([("x", "llm", "one two three"), ("y", "static", "one two")], "id string, source string, anchor string").select("id", "source", want)
    assert sorted(map(tuple, found.select("finding_id", "source", "fingerprint").collect())) == sorted(map(tuple, anchors.collect()))
