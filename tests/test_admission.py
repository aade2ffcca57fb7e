from pyspark.sql import functions as F

from verdigris.sources import admission, model_output, reports


def values(df, *columns):
    return sorted(tuple(row[name] for name in columns) for row in df.collect())


def test_clashing_paths_are_all_reported(spark):
    pairs = [("pkg/item.py", "pkg/item.py"), ("Pkg/Item.py", "pkg/item.py"), ("pkg\\item.py", "pkg/item.py"),
             ("pkg/cafe\u0301.py", "pkg/caf\u00e9.py"), ("pkg//item.py", "pkg/item.py")]
    rows = [(at, path) for at, pair in enumerate(pairs) for path in (*pair, "other.py")]
    keyed = admission.canonical_path(spark.createDataFrame(rows, "review_id int, path string"))
    found = admission.path_conflicts(keyed).groupBy("review_id").count().collect()
    assert sorted((row.review_id, row["count"]) for row in found) == [(at, 2) for at in range(5)]


def test_invalid_paths(spark):
    rows = [("/etc/a",), ("C:\\a",), ("../a",), ("a/../../b",), ("",), (".",), ("a/../b.py",)]
    got = admission.canonical_path(spark.createDataFrame(rows, "path string")).collect()
    assert [row.path_error for row in got] == ["invalid_path"] * 6 + [None]
    assert got[-1].canonical_path == "b.py"


def test_bad_text_is_rejected(spark):
    rows = [("a", "x = 1\x00"), ("b", "x \ufffd"), ("c", "short\x01\x02"), ("d", " \n"), ("e", "x = 1\n"), ("f", "y" * 300 + "\x01")]
    checked = admission.admit_files(spark.createDataFrame(rows, "name string, content string"))
    assert dict((row.name, row.reject_reason) for row in checked.collect()) == {
        "a": "nul_character", "b": "replacement_character", "c": "control_characters", "d": "blank", "e": None, "f": None,
    }
    assert admission.accepted(checked).count() == 2 and admission.quarantined(checked).count() == 4


def test_byte_cap_is_sticky(spark):
    rows = [(1, at, "x" * size) for at, size in enumerate([4, 4, 4, 1, 0])] + [(2, 0, "x" * 10), (2, 1, "")]
    df = spark.createDataFrame(rows, "review_id int, ord int, content string")
    assert values(admission.cap_import_bytes(df, [F.col("ord")], cap=10), "review_id", "ord") == [(1, 0), (1, 1), (2, 0)]


def test_language_detection(spark):
    rows = [
        ("a.py", None, "import os\n\ndef f(x):\n    return x\n", "python", None),
        ("a.cpp", None, "#include <vector>\nint main() { return 0; }\n", "cpp", None),
        ("a.py", None, "function f() { return 1 }\nimport os\n", "cpp", "unsupported_syntax"),
        ("a.cpp", None, "def f(x):\n    return x\n", "python", "extension_differs"),
        ("a.rb", None, "def f(x):\n    return x\n", "python", "unsupported_extension"),
        ("a", "cpp", "def f(x):\n    return x\n", "python", "declared_language_differs"),
        ("a", None, "hello world", None, "not_recognised"),
    ]
    df = spark.createDataFrame(rows, "path string, declared string, content string, language string, problem string")
    for row in admission.detect_language(df, declared="declared").collect():
        assert (row.detected, row.language_error) == (row.language, row.problem), row.content


def test_read_source_tree_and_offsets(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("é\n\nx\n", encoding="utf-8")
    loaded = admission.load_files(admission.read_source_tree(spark, str(tmp_path), "*.py")).first()
    assert loaded.line_offsets == [0, 2, 3, 5] and len(loaded.sha256) == 64


def test_model_output_quarantine_and_salvage(spark):
    finding = (
        '{"rule_id":"r","severity":"low","confidence":0.9,"category":"c","file":"f","start_line":2,"end_line":1,'
        '"title":"t","evidence":"e","impact":"i","suggestion":"s"}'
    )
    rows = [
        (1, '{"summary":"s","findings":[],"uncovered":[]}', "stop"),
        (2, '{"summary":"s","findings":[%s],"uncovered":[]}' % finding, "stop"),
        (3, '{"summary":"s \\"q\\"","findings":[{"title":"cut of', "stop"),
        (4, '{"summary":"s","findings":[],"uncovered":[]}', "length"),
        (5, '{"summary":"s","findings":[%s],"uncovered":[]}' % ",".join([finding.replace('"end_line":1', '"end_line":3')] * 51), "stop"),
        (6, "plain words", "stop"),
    ]
    parsed = model_output.parse_model_output(spark.createDataFrame(rows, "id int, content string, finish_reason string"))
    assert {row.id: row.output_error for row in parsed.collect()} == {
        1: None, 2: "invalid_finding", 3: "truncated", 4: "truncated", 5: "too_many_items", 6: "not_a_json_object",
    }
    bad = model_output.rejected_output(parsed).where("id = 3")
    assert values(model_output.salvage_truncated_output(bad, ["id"]), "position", "field", "text") == [(1, "summary", 's "q"'), (2, "title", "cut of")]


def test_diagnostics(spark):
    rows = [("F821", "Undefined name `missing`", (2, 5), None), ("F401", "`os` imported but unused", (0, 1), (1, 3)), ("E501", "too long", (1, 1), None)]
    schema = "code string, message string, location struct<row:int,column:int>, end_location struct<row:int,column:int>"
    got = reports.load_diagnostics(spark.createDataFrame(rows, schema), "linter", [])
    assert values(got, "rule_id", "start_line", "evidence") == [("python.undefined-name", 2, "missing"), ("python.unused-import", 1, "os")]


def test_merge_request_json(spark, tmp_path):
    path = tmp_path / "diffs.json"
    path.write_text(
        '{"review_id":"1","old_path":"a.py","new_path":"a.py","new_file":true,"deleted_file":true,"diff":"@@ -1 +3,2 @@"}\n'
        '{"review_id":"1","old_path":"b.py","new_path":"b.py","diff":"%s"}\n' % ("x" * 40_001)
    )
    got = {row.new_path: row for row in reports.read_merge_request_diffs(spark, str(path)).collect()}
    assert got["a.py"].change_type == "added" and got["a.py"].selectable
    assert got["b.py"].unavailable_reason == "incomplete_diff" and len(got["b.py"].diff) == 40_000


def test_each_way_in_has_its_own_extensions(spark):
    rows = spark.createDataFrame([("a.h", "#include <x>\nint main() {}\n"), ("b.PYW", "import os\n"), ("c.c", "#include <x>\n")], "path string, content string")
    errors = lambda **more: {row["path"]: row["language_error"] for row in admission.detect_language(rows, **more).collect()}
    assert errors() == {"a.h": "unsupported_extension", "b.PYW": None, "c.c": "unsupported_extension"}
    assert errors(extensions=admission.LOCAL_EXTENSIONS) == {"a.h": None, "b.PYW": None, "c.c": None}
    merge = rows.select("path", admission.extension_language("path", admission.MERGE_EXTENSIONS).alias("language")).collect()
    assert {row["path"]: row["language"] for row in merge} == {"a.h": "cpp", "b.PYW": None, "c.c": "cpp"}
