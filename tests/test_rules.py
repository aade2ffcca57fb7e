"""Constraints of drafts, answers, files and claims."""

from pyspark.sql import functions as F

from verdigris.operators import quality


def broken(df, rules):
    return [tuple(row["broken_rules"]) for row in quality.broken_rules(df, rules).collect()]


def test_claims(spark):
    schema = "root_cause struct<claim:string,concrete_failing_input:string,expected_behavior:string,actual_behavior:string,affected_path:string,repair_invariant:string,contract_evidence:string,reachable_path:string>"
    whole = ("c", "i", "e", "a", "p", "r")
    rows = [(None,), ((*whole, "k", None),), ((*whole, None, "x"),), ((*whole, "", None),), (("c", None, "e", "", "p", "r", "k", None),)]
    found = broken(spark.createDataFrame(rows, schema), quality.claim_rules())
    assert found == [(), (), (), ("claim_verifiable",), ("actual_behavior_present", "concrete_failing_input_present")]


def test_files_and_answers(spark):
    files = spark.createDataFrame([("f", "a.py", "python", "a" * 64), ("", "a.py", "java", "A" * 64), ("f", None, "cpp", "a" * 63)], "file_id string, path string, language string, sha256 string")
    assert broken(files, quality.file_rules()) == [(), ("file_id_present", "hash_well_formed", "language_known"), ("hash_well_formed", "path_present")]
    answers = spark.createDataFrame([("s", ["x"] * 50, []), ("", ["x"] * 51, ["y"])], "summary string, findings array<string>, uncovered array<string>")
    assert broken(answers, quality.answer_rules()) == [(), ("findings_at_most_50", "summary_present")]


def test_drafts(spark):
    schema = "rule_id string, category string, file string, title string, evidence string, impact string, suggestion string, confidence double, severity string, start_line int, end_line int"
    drafts = spark.createDataFrame([("r", "c", "f", "t", "e", "i", "s", 1.0, "low", 1, 1), ("r", "c", "f", "", "e", "i", None, 1.1, "worst", 0, -1)], schema)
    assert broken(drafts, quality.draft_rules()) == [
        (), ("confidence_in_unit_range", "end_not_before_start", "positive_lines", "severity_known", "suggestion_present", "title_present")
    ]


def test_schema_problems(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, name string")
    rows = {row["problem"]: row["rows"] for row in quality.schema_problems(df, df.schema, ["id"]).collect()}
    assert rows == {"null key": 1, "repeated key": 1}
    assert quality.schema_problems(df.where(F.col("name") == "a"), df.schema, ["id"]).count() == 0
