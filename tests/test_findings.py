import time
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import aggregates, intervals, joins, merging, scoring, windows

COLUMNS = "finding_id string, file_id int, rule_id string, symbol string, evidence string, source string, start_line int, end_line int, start_column int"


def merged(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return sorted((row.finding_id, row.deduplicated) for row in merging.merge_findings(df).collect())


def expected_merge(rows):
    """The rule as stated: ordered, compared with survivors only."""
    survivors = []
    for row in sorted(rows, key=lambda r: (r[5] != "static", r[6], r[8], r[0])):
        identity = (row[1], row[2], row[3], text_key(row[4]))
        hit = next((s for s in survivors if s["identity"] == identity and s["row"][6] <= row[7] and row[6] <= s["row"][7]), None)
        if hit is None:
            survivors.append({"identity": identity, "row": row, "dup": False})
        else:
            hit["dup"] = True
            if hit["row"][5] != "static":
                hit["row"] = row
    return sorted((s["row"][0], s["dup"]) for s in survivors)


def text_key(value):
    return " ".join(value.lower().split())


def chain(sources):
    return [(f"f{at}", 1, "r", None, "e", source, *span, 1) for at, (source, span) in enumerate(zip(sources, [(1, 3), (3, 5), (5, 7)]))]


def test_greedy_chain(spark):
    assert merged(spark, chain(["llm", "llm", "llm"])) == [("f2", True)]
    assert merged(spark, chain(["static", "llm", "llm"])) == [("f0", True), ("f2", False)]


def test_distinct_issues_on_one_line_survive(spark):
    rows = [("a", 1, "security.command", None, "run", "llm", 1, 1, 1), ("b", 1, "security.path", None, "value", "llm", 1, 1, 1)]
    assert merged(spark, rows) == [("a", False), ("b", False)]


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_the_ordered_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for at in range(500):
        start = rng.randint(1, 60)
        rows.append(
            (f"f{at:04d}", 1 if rng.random() < 0.4 else rng.randint(2, 6), rng.choice("ab"), rng.choice([None, "", "s"]), rng.choice(["x  Y", "X y", "z"]),
             rng.choice(["static", "llm", "llm"]), start, start + rng.choice([0, 0, 1, 3, 9]), rng.randint(1, 3))
        )
    rows += [(f"copy{at:03d}", 1, "a", None, "x y", "llm", 5, 9, 1) for at in range(100)]
    assert merged(spark, rows) == expected_merge(rows)
    once = merging.merge_findings(spark.createDataFrame(rows, COLUMNS)).drop("deduplicated")
    again = merging.merge_findings(once)
    assert again.count() <= once.count()


def test_overlap_counts_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(at, rng.randint(1, 2), rng.randint(1, 30), 0) for at in range(300)]
    rows = [(at, file_id, start, start + rng.randint(0, 8)) for at, file_id, start, _ in rows]
    got = intervals.overlap_counts(spark.createDataFrame(rows, "finding_id int, file_id int, start_line int, end_line int")).collect()
    for row in got:
        want = sum(f == row.file_id and s <= row.end_line and row.start_line <= e for _, f, s, e in rows) - 1
        assert row.overlapping == want


def test_risk_table(spark):
    want = [24, 29, 35, 41, 47, 53, 59, 65, 71, 76, 82, 88, 94, 100]
    rows = [
        (2 * i + 2 * e + x, impact, exploit, exposure)
        for impact, i in scoring.IMPACT_POINTS.items()
        for exploit, e in scoring.EXPLOITABILITY_POINTS.items()
        for exposure, x in scoring.EXPOSURE_POINTS.items()
    ]
    df = spark.createDataFrame(rows, "raw int, impact_level string, exploitability string, exposure string").select(
        "*", *[F.lit("x").alias(name) for name in ("rule_id", "category", "title", "evidence", "impact")]
    )
    got = {row.raw: row.risk_score for row in scoring.score_risk(df).collect()}
    assert [got[raw] for raw in range(4, 18)] == want


def test_literal_eval_confusion_is_dropped(spark):
    rows = [("use of eval( is dangerous", "literal_eval(x)"), ("slow literal_eval( call", "literal_eval(x)")]
    drafts = spark.createDataFrame(rows, "title string, evidence string").select(
        "*", F.lit(1).alias("review_id"), F.lit("a.py").alias("file"), F.lit("rule").alias("rule_id"), F.lit("security").alias("category"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
    )
    files = spark.createDataFrame([(1, "a.py", 3)], "review_id int, path string, line_count int")
    got = {row.title: row.gate_reason for row in scoring.gate_drafts(drafts, files).collect()}
    assert list(got.values()).count("literal_eval_confusion") == 1 and got["slow literal_eval( call"] is None


def test_policy_rule(spark):
    rule = {"rule_id": "r", "severity": "high", "include_paths": ["pkg/**"], "allowed_fix_safety": ["safe"]}
    rows = [("a", "r", "pkg/model.py", "medium"), ("b", "r", "lib/model.py", "medium"), ("c", "other", "lib/x.py", "low")]
    findings = spark.createDataFrame(rows, "finding_id string, rule_id string, path string, severity string").select(
        "*", F.lit("requires_review").alias("fix_safety"), F.lit("applicable").alias("applicability")
    )
    got = {row.finding_id: (row.severity, row.applicability) for row in joins.apply_policy(findings, joins.policy_table(spark, [rule])).collect()}
    assert got == {"a": ("high", "requires_review"), "c": ("low", "applicable")}


def test_judge_budget(spark):
    rows = [("s", 1, "static", 1), ("l1", 1, "llm", 2), ("l2", 1, "llm", 3)]
    findings = spark.createDataFrame(rows, "finding_id string, review_id int, source string, ord int")
    assert [row.finding_id for row in windows.judge_budget(findings, ["ord"], budget=1).collect()] == ["l1"]
    verdicts = spark.createDataFrame([("l1", True, 0.6)], "finding_id string, accepted boolean, confidence double")
    assert sorted(row.finding_id for row in windows.apply_judgements(findings, verdicts).collect()) == ["l2", "s"]


def test_golden_metrics_all_right(spark):
    rows = [("c1", "python.undefined-name", "a.py", 2), ("c2", "r", "b.py", 1), ("c3", "r", "c.py", 4)]
    schema = "case_id string, rule_id string, path string, line int"
    df = spark.createDataFrame(rows, schema)
    got = aggregates.golden_metrics(df, df, ["case_id", "rule_id", "path", "line"]).first()
    assert (got.precision, got.recall, got.false_positive_rate, got.true_positive) == (1.0, 1.0, 0.0, 3)
    assert aggregates.golden_failures(df, df.limit(0)).count() == 3
    none = aggregates.golden_metrics(df.limit(0), df.limit(0), ["case_id", "rule_id", "path", "line"]).first()
    assert (none.precision, none.recall, none.false_positive_rate) == (1.0, 1.0, 0.0)


def test_coverage_never_above_100(spark):
    significant = spark.createDataFrame([(1, line) for line in (1, 2, 5, 70, 130)], "file_id int, line int")
    spans = [(1, 1, 3, "completed"), (1, 2, 5, "completed"), (1, 60, 140, "superseded"), (1, 70, 70, "completed")]
    got = intervals.line_coverage(significant, spark.createDataFrame(spans, "file_id int, target_start_line int, target_end_line int, status string")).first()
    assert (got.required, got.covered, got.percent, got.first_missing_line) == (5, 4, 80.0, 130)


def test_glob_crosses_folders():
    import re

    for pattern, path, hit in [("pkg/**", "pkg/a/b.py", True), ("*.py", "a/b.py", True), ("a?.py", "ab.py", True), ("[!a]*.py", "a.py", False), ("a+b/*", "a+b/c", True)]:
        assert bool(re.match(text.glob_to_regex(pattern), path)) is hit, pattern


def test_fingerprint_equals_plain_hash(spark):
    import hashlib

    df = spark.createDataFrame([("Pkg/A.py", "f1", "Rule", None, " A\t b ")], "path string, file_id string, rule_id string, symbol string, evidence string")
    got = df.select(text.fingerprint(*[F.col(name) for name in df.columns]).alias("key")).first().key
    assert got == hashlib.sha256("\x1f".join(["pkg/a.py", "rule", "", "a b"]).encode()).hexdigest()


def test_split_lines_like_plain_text(spark):
    samples = ["a\nb", "a\n", "", "\n", "a\r\nb\rc\x0bd\u2028e", "a\n\n"]
    df = spark.createDataFrame([(sample,) for sample in samples], "content string")
    assert [row.lines for row in df.select(text.split_lines("content").alias("lines")).collect()] == [sample.splitlines() for sample in samples]


def test_merging_one_hot_identity_takes_linear_time(spark):
    """A hundred thousand disjoint static spans of one identity, every fourth hit again by an overlapping one."""
    n = 100_000
    base = spark.range(n).selectExpr("1 as file_id", "'r' as rule_id", "'s' as symbol", "'e' as evidence", "'static' as source", "id")
    spans = base.selectExpr("*", "cast(10 * id as int) as start_line", "cast(10 * id + 5 as int) as end_line", "0 as start_column", "concat('a', id) as finding_id")
    again = base.where("id % 4 = 0").selectExpr("*", "cast(10 * id + 3 as int) as start_line", "cast(10 * id + 4 as int) as end_line", "0 as start_column", "concat('b', id) as finding_id")
    began = time.time()
    got = merging.merge_findings(spans.unionByName(again)).groupBy("deduplicated").count().collect()
    assert {row["deduplicated"]: row["count"] for row in got} == {True: n // 4, False: n - n // 4}
    assert time.time() - began < 90
