import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions import extensions
from verdigris.operators import governance, quality
from verdigris.sinks import exports, tables


def people(spark):
    users = spark.createDataFrame([(1, "admin", True), (2, "user", True), (3, "user", True)], "user_id int, role string, is_active boolean")
    reviews = spark.createDataFrame([(10, 2), (11, 3)], "review_id int, owner_id int")
    events = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "review_id int, sequence int")
    sessions = spark.createDataFrame([("s2", 2), ("s3", 3)], "session_id string, user_id int")
    return {"users": users, "reviews": reviews, "events": events, "auth_sessions": sessions, "findings": events.select("review_id")}


def test_purge_is_a_new_version(spark, tmp_path):
    root = str(tmp_path)
    held = people(spark)
    tables.write_version(held, root, 1)
    left, outcome = governance.purge_users(tables.read_version(spark, root, list(held)), spark.createDataFrame([(3,), (1,), (9,), (3,)], "user_id int"))
    assert {row.user_id: row.result for row in outcome.collect()} == {1: "protected", 3: "purged", 9: "unknown"}
    tables.write_version({"users": left["users"]}, root + "/other", 1)
    for name, df in left.items():
        tables.write_table(df, f"{root}/version=2/{name}")
    assert tables.current_version(spark, root) == 1  # not committed: the old version still counts
    tables.write_version(left, root, 3)
    now = tables.read_version(spark, root, list(held))
    assert {name: df.count() for name, df in now.items()} == {"users": 2, "reviews": 1, "events": 1, "auth_sessions": 1, "findings": 1}


def test_reset_keeps_events(spark):
    left = governance.reset_review(people(spark), spark.createDataFrame([(11,)], "review_id int"))
    assert left["events"].count() == 3 and left["findings"].count() == 1


def test_activation_is_partial(spark):
    held = people(spark)
    results = governance.batch_set_active(held["users"], spark.createDataFrame([(2,), (1,), (2,), (7,)], "user_id int"), active=False)
    assert {row.user_id: row.error for row in results.collect()} == {2: None, 1: "protected", 7: "unknown"}
    assert [row.user_id for row in governance.apply_activation(held["users"], results).where("NOT is_active").collect()] == [2]
    assert [row.session_id for row in governance.drop_disabled_sessions(held["auth_sessions"], results).collect()] == ["s3"]


def test_owners_never_mix(spark):
    current = spark.createDataFrame([(1, "alice", 1, "a")], "review_id int, owner_id string, version int, value string")
    changes = spark.createDataFrame([(1, "bob", 2, "b"), (2, "bob", 1, "c"), (1, "alice", 3, "d")], current.schema)
    merged = tables.upsert_owned(current, changes, ["review_id"], ["version"])
    assert sorted((row.review_id, row.value) for row in merged.collect()) == [(1, "d"), (2, "c")]
    children = spark.createDataFrame([(1, "alice"), (1, "bob"), (5, "bob")], "review_id int, owner_id string")
    assert sorted(row.problem for row in governance.isolation_audit(children, merged).collect()) == ["no_review", "other_owner"]


def test_replace_partition_leaves_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string"), path, ["part"])
    tables.replace_partition(spark.createDataFrame([(3, "b")], "id int, part string"), path, ["part"])
    assert sorted((row.id, row.part) for row in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_schema_and_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string")
    expected = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("extra", T.StringType())])
    assert quality.schema_differences(df, expected) == ["missing column extra", "id is int, expected bigint"]
    assert quality.schema_differences(df, df.schema) == []
    assert [tuple(row) for row in quality.duplicate_keys(df, ["id"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        quality.require_no_orphans(df, df.where("id = 2"), "id")
    assert quality.sole_admin(people(spark)["users"]).first().user_id == 1


def test_report_text(spark, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    reviews = spark.createDataFrame([("r1", "completed", "nothing found")], "review_id string, status string, summary string").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    lines = exports.report_lines(
        reviews,
        spark.createDataFrame([("r1", "f", "a.py", "00")], "review_id string, file_id string, path string, sha256 string"),
        spark.createDataFrame([("r1", "x", "f", "low", 2, 3, 0.9, "a title", "e", "i", "s")], "review_id string, finding_id string, file_id string, severity string, start_line int, end_line int, confidence double, title string, evidence string, impact string, suggestion string"),
        empty("finding_id string, decision string"),
        empty("review_id string, finding_id string, action string, decision string, created_at timestamp, reason string, revision_retained boolean"),
        empty("review_id string, language string, analyzer string, available boolean, message string"),
        empty("review_id string, revision_id string, created_at timestamp, path string, before_sha256 string, after_sha256 string, explanation string, validation array<string>, diff string, undone_at timestamp"),
    )
    exports.write_reports(lines, str(tmp_path / "reports"))
    text = "\n".join(row.value for row in spark.read.text(str(tmp_path / "reports" / "review_id=r1")).collect())
    assert text.startswith("# 代码审查报告\n\n- 审查 ID：r1") and "### 1. a title" in text and "`a.py:2-3`" in text
    assert text.index("## 已修复") < text.index("## 待处理") < text.index("## 处理历史") < text.index("## 修订 Diff")


def test_reports_in_buckets(spark, tmp_path):
    lines = spark.createDataFrame([(at % 50, at % 3, f"{at:03d}", f"text {at}") for at in range(600)], "review_id int, section int, item string, text string")
    path = str(tmp_path / "reports")
    exports.write_report_buckets(lines, path, buckets=4)
    want = "\n".join(f"text {at}" for at in sorted((at for at in range(600) if at % 50 == 7), key=lambda at: (at % 3, at)))
    assert exports.read_report(spark, path, 7, buckets=4) == want and exports.read_report(spark, path, 99, buckets=4) == ""
    assert len(list((tmp_path / "reports").glob("bucket=*"))) <= 4


def test_origin_text(spark):
    rows = [(1, "merge_request", "g/a", 5, "https://x/5", "b", "h", None, None, ["a", "b"]), (2, "local", None, None, None, None, None, "old", "new", None), (3, "paste", *[None] * 8)]
    origins = spark.createDataFrame(rows, "review_id int, kind string, project_path string, request_number int, request_url string, base_sha string, head_sha string, old_label string, new_label string, selected_paths array<string>")
    got = {row["review_id"]: row["origin_text"] for row in exports.origin_text(origins).collect()}
    assert "[g/a !5](https://x/5)" in got[1] and got[1].endswith("2\n") and "old" in got[2] and got[2].endswith("0\n") and got[3] is None


def test_analyzer_admission(spark):
    files = spark.createDataFrame([(1, "a.py", "x"), (2, "../a.py", "x"), (3, "/a.py", "x"), (4, "b.py", "y" * 1_000_001)], "file_id int, path string, content string")
    found = extensions.apply_analyzer(files, lambda path, content: [("rule", "info", 1, 1, 1, 2, path)])
    assert [tuple(row) for row in found.select("file_id", "message").collect()] == [(1, "a.py")]
