"""Queries over sources: admission, reports, model output."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.plans.bindings import ATTEMPTS_SQL, EVENTS_SQL, FILES_SQL, PATHS_SQL, SPANS_SQL, Tables, with_views
from verdigris.plans.registry import query
from verdigris.sources import admission, model_output, reports


@query(
    "load_files",
    with_views(FILES_SQL)
    + """
    SELECT file_id, sha256(content) AS sha256, len(string_split(content, chr(10))) AS n_offsets,
           length(content) - length(string_split(content, chr(10))[-1]) AS last_offset
    FROM files""",
)
def _(t: Tables):
    loaded = admission.load_files(t.files)
    return loaded.select(
        "file_id",
        "sha256",
        F.size("line_offsets").alias("n_offsets"),
        F.element_at("line_offsets", -1).alias("last_offset"),
    )


def messy_paths(t: Tables):
    """Page paths with the irregularities of uploaded names."""
    kind = F.col("page_id") % 5
    return t.paths.withColumn(
        "path",
        F.when(kind == 0, F.replace("path", F.lit("/"), F.lit("\\")))
        .when(kind == 1, F.concat("path", F.lit("/../x")))
        .when(kind == 2, F.concat(F.lit("/"), "path"))
        .when(kind == 3, F.concat(F.lit("./"), "path", F.lit("//.//End")))
        .otherwise(F.concat(F.lit("../"), "path")),
    )


@query(
    "canonical_path",
    with_views(PATHS_SQL)
    + r"""
    , messy AS (
      SELECT page_id, CASE page_id % 5
          WHEN 0 THEN path WHEN 1 THEN regexp_replace(rtrim(path, '/') || '/../x', '/[^/]+/\.\./', '/')
          WHEN 3 THEN rtrim(path, '/') || '/End' END AS path FROM paths),
    tidy AS (SELECT page_id, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS path FROM messy)
    SELECT page_id, path AS canonical_path, lower(path) AS path_key,
           CASE WHEN path IS NULL THEN 'invalid_path' END AS path_error FROM tidy""",
)
def _(t: Tables):
    return admission.canonical_path(messy_paths(t)).select("page_id", "canonical_path", "path_key", "path_error")


def dirty_files(t: Tables):
    """Documents, some of them with the defects that admission looks for."""
    kind = F.col("file_id") % 7
    return t.files.withColumn(
        "content",
        F.when(kind == 1, F.concat("content", F.lit("�")))
        .when(kind == 2, F.concat("content", F.lit("\x01\x02")))
        .when(kind == 3, F.lit(" \n "))
        .otherwise(F.col("content")),
    )


DIRTY_SQL = """dirty AS (
  SELECT file_id, review_id, CASE file_id % 7 WHEN 1 THEN content || chr(65533) WHEN 2 THEN content || chr(1) || chr(2)
         WHEN 3 THEN ' ' || chr(10) || ' ' ELSE content END AS content FROM files)"""


@query(
    "admit_files",
    with_views(FILES_SQL, DIRTY_SQL)
    + """
    SELECT file_id, CASE
        WHEN strlen(content) > 20000 THEN 'too_large' WHEN trim(replace(content, chr(10), '')) = '' THEN 'blank'
        WHEN contains(content, chr(65533)) THEN 'replacement_character'
        WHEN (length(content) - length(replace(replace(content, chr(1), ''), chr(2), ''))) / length(content) > 0.01 THEN 'control_characters'
        ELSE 'admitted' END AS outcome FROM dirty""",
)
def _(t: Tables):
    checked = admission.admit_files(dirty_files(t), max_bytes=20000)
    return checked.select("file_id", F.coalesce("reject_reason", F.lit("admitted")).alias("outcome"))


@query(
    "path_conflicts",
    with_views(PATHS_SQL)
    + r"""
    , keyed AS (SELECT page_id, review_id, lower(rtrim(regexp_extract(path, '/([^?#]*)', 1), '/')) AS path_key FROM paths)
    SELECT page_id, review_id, path_key FROM keyed
    WHERE path_key <> '' AND (review_id, path_key) IN (SELECT (review_id, path_key) FROM keyed GROUP BY review_id, path_key HAVING count(*) > 1)""",
)
def _(t: Tables):
    inside = t.paths.withColumn("path", F.regexp_extract("path", "/([^?#]*)", 1)).withColumn(
        "path", F.when(F.col("page_id") % 2 == 0, F.upper("path")).otherwise(F.col("path"))
    )
    return admission.path_conflicts(admission.canonical_path(inside)).select("page_id", "review_id", "path_key")


@query(
    "cap_import_bytes",
    with_views(FILES_SQL)
    + """
    , sized AS (
      SELECT file_id, review_id, strlen(content) AS size, row_number() OVER (PARTITION BY review_id ORDER BY file_id) AS position FROM files),
    summed AS (SELECT *, sum(size) OVER (PARTITION BY review_id ORDER BY position) AS cumulative FROM sized WHERE position <= 200)
    SELECT file_id, review_id, position, CAST(cumulative AS BIGINT) AS cumulative_bytes
    FROM summed WHERE cumulative <= 60000 AND cumulative - size < 60000""",
)
def _(t: Tables):
    capped = admission.cap_import_bytes(t.files, [F.col("file_id")], cap=60000)
    return capped.select("file_id", "review_id", "position", "cumulative_bytes")


@query(
    "reject_oversize_import",
    with_views(FILES_SQL)
    + """
    SELECT file_id, review_id FROM files
    WHERE review_id IN (SELECT review_id FROM files GROUP BY review_id HAVING sum(strlen(content)) <= 130000)""",
)
def _(t: Tables):
    return admission.reject_oversize_import(t.files, cap=130000).select("file_id", "review_id")


def code_like(t: Tables):
    """Whole documents wrapped in a little code, with file names that sometimes disagree."""
    kind = F.col("file_id") % 5
    return t.files.withColumns(
        {
            "content": F.when(kind == 0, F.concat(F.lit("import os\n"), "content"))
            .when(kind == 1, F.concat(F.lit("#include <a>\nint main() {\n"), "content", F.lit("\n}")))
            .when(kind == 2, F.concat("content", F.lit("\nlet x = 1")))
            .when(kind == 3, F.concat(F.lit("class A:\n    x = 1\n"), "content"))
            .otherwise(F.col("content")),
            "path": F.concat(
                F.lit("f"),
                F.col("file_id").cast("string"),
                F.element_at(F.array(*[F.lit(item) for item in (".py", ".cpp", "", ".txt")]), (F.floor(F.col("file_id") / 5) % 4 + 1).cast("int")),
            ),
        }
    )


W = r"[\p{L}\p{N}_]"


@query(
    "detect_language",
    with_views(FILES_SQL)
    + rf"""
    , code AS (
      SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'import os' || chr(10) || content
               WHEN 1 THEN '#include <a>' || chr(10) || 'int main() {{' || chr(10) || content || chr(10) || '}}'
               WHEN 2 THEN content || chr(10) || 'let x = 1'
               WHEN 3 THEN 'class A:' || chr(10) || '    x = 1' || chr(10) || content ELSE content END AS content,
             (file_id // 5) % 4 AS kind FROM files),
    scored AS (
      SELECT file_id, kind,
        CASE WHEN file_id % 5 = 2 THEN 'unsupported_syntax' END AS syntax,
        CASE WHEN regexp_matches(content, '(^|\n)\s*(?:class\s+\w+(?:\([^)]*\))?)\s*:|(^|\n)\s*(?:import|from)\b') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(content, '\b(print|eval|exec|input)\s*\(') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(content, '(?m)^\s*[A-Za-z_]{W}*\s*=(?:[^=;\n][^;\n]*)?$') THEN 2 ELSE 0 END
        + CASE WHEN regexp_matches(content, '(?m)^\s*[A-Za-z_]{W}*\s*:\s*[^=\n]+(?:=\s*[^;\n]+)?$') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(content, '(?m)^\s{{4,}}\S+') AND regexp_matches(content, ':\s*(\n|$)') THEN 1 ELSE 0 END AS python_score,
        CASE WHEN file_id % 5 = 1 THEN 10 ELSE 0 END
        + CASE WHEN (kind = 1 OR regexp_matches(content, '\b(?:public|private|protected)\s*:')) AND regexp_matches(content, '\b(?:class|struct|enum)\s+\w+') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(content, '(?m)[{{}}]\s*$|;\s*(?:\n|$)') THEN 1 ELSE 0 END
        + CASE WHEN regexp_matches(content, '\b(?:int|void|char|float|double)\s+\w+\s*(?:=|;)') THEN 1 ELSE 0 END AS cpp_score
      FROM code),
    found AS (
      SELECT *, CASE WHEN python_score >= 2 AND python_score > cpp_score THEN 'python'
                     WHEN cpp_score >= 2 AND cpp_score > python_score THEN 'cpp' END AS detected FROM scored)
    SELECT file_id, python_score, cpp_score, detected,
           coalesce(CASE WHEN kind = 3 THEN 'unsupported_extension' END, syntax,
                    CASE WHEN detected IS NULL THEN 'not_recognised' END,
                    CASE WHEN (kind = 0 AND detected <> 'python') OR (kind = 1 AND detected <> 'cpp') THEN 'extension_differs' END) AS language_error
    FROM found""",
)
def _(t: Tables):
    return admission.detect_language(code_like(t)).select("file_id", "python_score", "cpp_score", "detected", "language_error")


def response_log(t: Tables):
    """A response log whose bodies come from the event rows: whole, fenced, cut off, not an object, invalid."""
    confidence = F.when(F.col("attempt_id") % 5 == 4, "1.5").otherwise("0.5")
    body = F.concat(
        F.lit('{"summary":"note '), "event",
        F.lit('","findings":[{"rule_id":"rule.'), "event",
        F.lit('","severity":"high","confidence":'), confidence,
        F.lit(',"category":"security","file":"f'), F.col("review_id").cast("string"),
        F.lit('.py","start_line":'), F.col("tokens").cast("string"),
        F.lit(',"end_line":'), (F.col("tokens") + 2).cast("string"),
        F.lit(',"title":"issue \\"'), "event",
        F.lit('\\"","evidence":"line '), F.col("tokens").cast("string"),
        F.lit('","impact":"impact","suggestion":"fix it"}],"uncovered":[]}'),
    )
    kind = F.col("attempt_id") % 5
    content = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.substring(body, F.lit(1), F.length(body) - 40))
        .when(kind == 3, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return t.attempts.select("attempt_id", "event", content.alias("content"), F.lit("stop").alias("finish_reason"))


@query(
    "parse_model_output",
    with_views(ATTEMPTS_SQL)
    + """
    SELECT attempt_id, CASE WHEN attempt_id % 5 = 2 THEN 'truncated' WHEN attempt_id % 5 = 3 THEN 'not_a_json_object'
      WHEN attempt_id % 5 = 4 OR tokens < 1 THEN 'invalid_finding' END AS output_error
    FROM attempts""",
)
def _(t: Tables):
    return model_output.parse_model_output(response_log(t)).select("attempt_id", "output_error")


@query(
    "model_drafts",
    with_views(ATTEMPTS_SQL)
    + """
    SELECT attempt_id, 1 AS position, 'rule.' || event AS rule_id, 'f' || review_id || '.py' AS file, tokens AS start_line, tokens + 2 AS end_line,
           'issue "' || event || '"' AS title, 'medium' AS impact_level, 'unknown' AS exposure
    FROM attempts WHERE tokens > 0 AND attempt_id % 5 < 2""",
)
def _(t: Tables):
    drafts = model_output.drafts_of(model_output.parse_model_output(response_log(t)), ["attempt_id"])
    return drafts.select(
        "attempt_id", "position", "rule_id", "file", "start_line", "end_line", "title", "impact_level", "exposure"
    )


@query(
    "salvage_truncated_output",
    with_views(ATTEMPTS_SQL)
    + """
    , cut AS (SELECT attempt_id, event, tokens FROM attempts WHERE attempt_id % 5 = 2)
    SELECT attempt_id, 1 AS position, 'summary' AS field, 'note ' || event AS text FROM cut UNION ALL
    SELECT attempt_id, 2, 'title', 'issue "' || event || '"' FROM cut UNION ALL
    SELECT attempt_id, 3, 'evidence', 'line ' || tokens FROM cut UNION ALL
    SELECT attempt_id, 4, 'impact', 'impact' FROM cut""",
)
def _(t: Tables):
    bad = model_output.rejected_output(model_output.parse_model_output(response_log(t)))
    return model_output.salvage_truncated_output(bad.where("output_error = 'truncated'"), ["attempt_id"])


@query(
    "plain_answers",
    with_views(ATTEMPTS_SQL)
    + """
    SELECT attempt_id, CASE attempt_id % 3 WHEN 0 THEN 'answer ' || event WHEN 1 THEN 'reply ' || tokens ELSE event END AS answer FROM attempts""",
)
def _(t: Tables):
    kind = F.col("attempt_id") % 3
    content = (
        F.when(kind == 0, F.concat(F.lit('```\n{"answer":"  ","message":"answer '), "event", F.lit('"}\n```')))
        .when(kind == 1, F.concat(F.lit('{"content":"reply '), F.col("tokens").cast("string"), F.lit(' "}')))
        .otherwise(F.col("event"))
    )
    return t.attempts.select("attempt_id", model_output.plain_answer(content).alias("answer"))


@query(
    "payload_to_columns",
    with_views(EVENTS_SQL)
    + """
    SELECT event_id, event, CAST(json_extract_string(data, '$.k') AS INTEGER) AS k FROM log""",
)
def _(t: Tables):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("event_id", T.LongType())])
    return model_output.payload_to_columns(t.events.select("event_id", "event", "data"), "data", schema, ["event_id"])


@query(
    "columns_to_payload",
    with_views(EVENTS_SQL)
    + """
    SELECT event_id, '{"event_id":' || event_id || ',"review_id":' || review_id || ',"event":"' || event || '"}' AS payload FROM log""",
)
def _(t: Tables):
    return model_output.columns_to_payload(t.events.select("event_id", "review_id", "event"), ["event_id"])


@query(
    "merge_request_changes",
    with_views(SPANS_SQL)
    + """
    , raw AS (
      SELECT finding_id, part_id % 4 AS kind, CASE supplier_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.hpp' ELSE '.md' END AS suffix,
             start_line, end_line, severity = 'critical' AS cut, rule_id = 'rule.R' AS generated, file_id FROM spans)
    SELECT finding_id, 'src/f' || file_id || suffix AS new_path,
           CASE kind WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS change_type,
           CASE suffix WHEN '.py' THEN 'python' WHEN '.hpp' THEN 'cpp' END AS language, cut AS diff_truncated,
           CASE WHEN suffix = '.md' THEN 'unsupported_language' WHEN generated THEN 'generated_file' WHEN cut THEN 'incomplete_diff'
                WHEN kind = 2 THEN 'deleted_file' END AS unavailable_reason
    FROM raw""",
)
def _(t: Tables):
    return reports.merge_request_changes(raw_changes(t)).select(
        F.col("review_id").alias("finding_id"), "new_path", "change_type", "language", "diff_truncated", "unavailable_reason"
    )


def raw_changes(t: Tables):
    kind = F.col("part_id") % 4
    suffix = F.element_at(F.array(F.lit(".py"), F.lit(".hpp"), F.lit(".md")), (F.col("supplier_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("src/f"), F.col("file_id").cast("string"), suffix)
    header = F.concat(
        F.lit("@@ -1,2 +"), F.col("start_line").cast("string"), F.lit(","),
        (F.col("end_line") - F.col("start_line")).cast("string"), F.lit(" @@ context\n+added\n@@ -9 +"),
        (F.col("end_line") + 5).cast("string"), F.lit(" @@\n+more"),
    )
    return t.spans.select(
        F.col("finding_id").alias("review_id"),
        name.alias("old_path"),
        F.when(kind == 2, F.lit("")).otherwise(name).alias("new_path"),
        (kind == 1).alias("new_file"),
        (kind == 2).alias("deleted_file"),
        (kind == 3).alias("renamed_file"),
        (F.col("rule_id") == "rule.R").alias("generated_file"),
        (F.col("severity") == "critical").alias("collapsed"),
        F.lit(None).cast("boolean").alias("too_large"),
        header.alias("diff"),
    )


@query(
    "hunk_ranges",
    with_views(SPANS_SQL)
    + """
    SELECT finding_id, start_line, end_line - 1 AS end_line FROM spans WHERE end_line > start_line
    UNION ALL SELECT finding_id, end_line + 5, end_line + 5 FROM spans""",
)
def _(t: Tables):
    return reports.hunk_ranges(raw_changes(t).withColumnRenamed("review_id", "finding_id"), ["finding_id"])


def linter_rows(t: Tables):
    code = F.when(F.col("rule_id") == "rule.A", "F821").when(F.col("rule_id") == "rule.N", "F401").otherwise("E501")
    message = (
        F.when(F.col("rule_id") == "rule.A", F.concat(F.lit("Undefined name `"), "symbol", F.lit("`")))
        .when(F.col("rule_id") == "rule.N", F.concat("symbol", F.lit(" imported but unused")))
        .otherwise("line too long")
    )
    return t.spans.select(
        "finding_id", "file_id", code.alias("code"), message.alias("message"),
        F.struct((F.col("start_line") - 1).alias("row"), F.col("start_column").alias("column")).alias("location"),
        F.struct(F.col("end_line").alias("row"), F.lit(None).cast("int").alias("column")).alias("end_location"),
    )


@query(
    "load_diagnostics",
    with_views(SPANS_SQL)
    + """
    SELECT finding_id, CASE rule_id WHEN 'rule.A' THEN 'python.undefined-name' ELSE 'python.unused-import' END AS rule_id, 'error' AS severity,
           greatest(1, start_line - 1) AS start_line, start_column, end_line, start_column AS end_column,
           CASE rule_id WHEN 'rule.A' THEN symbol ELSE symbol || ' imported but unused' END AS evidence
    FROM spans WHERE rule_id IN ('rule.A', 'rule.N')""",
)
def _(t: Tables):
    return reports.load_diagnostics(linter_rows(t), "linter", ["finding_id"]).drop("analyzer_id", "message")


@query(
    "load_compiler_log",
    with_views(SPANS_SQL)
    + """
    SELECT file_id AS review_id, 'src/m' || supplier_id || '.cpp' AS path, start_line, start_column,
           CASE source WHEN 'static' THEN 'cpp.compiler-error' ELSE 'cpp.compiler-warning' END AS rule_id,
           CASE source WHEN 'static' THEN 'medium' ELSE 'low' END AS severity, 'expected ' || rule_id AS message
    FROM spans WHERE severity <> 'info' AND supplier_id % 2 = 0""",
)
def _(t: Tables):
    path = F.concat(F.lit("src/m"), F.col("supplier_id").cast("string"), F.lit(".cpp"))
    level = F.when(F.col("severity") == "info", "note").when(F.col("source") == "static", "error").otherwise("warning")
    line = F.concat_ws(":", path, "start_line", "start_column", F.concat(F.lit(" "), level), F.concat(F.lit(" expected "), "rule_id"))
    log = t.spans.select("review_id", line.alias("value"))
    files = t.spans.where("supplier_id % 2 = 0").select("review_id", path.alias("path"))
    return reports.load_compiler_log(log, files, ["review_id"])


@query(
    "merge_diagnostics",
    with_views(SPANS_SQL)
    + """
    , builtin AS (SELECT file_id, rule_id, start_line, start_column, 'builtin ' || finding_id AS evidence FROM spans WHERE source = 'static'),
    tool AS (SELECT file_id, rule_id, start_line, start_column, min('tool ' || finding_id) AS evidence FROM spans WHERE source = 'llm' GROUP BY ALL)
    SELECT * FROM builtin UNION ALL
    SELECT * FROM tool WHERE NOT EXISTS (SELECT 1 FROM builtin b WHERE b.file_id = tool.file_id AND b.rule_id = tool.rule_id
      AND b.start_line = tool.start_line AND b.start_column = tool.start_column)""",
)
def _(t: Tables):
    row = lambda label: ["file_id", "rule_id", "start_line", "start_column", F.concat(F.lit(label), "finding_id").alias("evidence")]
    builtin = t.spans.where("source = 'static'").select(*row("builtin "))
    tool = t.spans.where("source = 'llm'").select(*row("tool "))
    return reports.merge_diagnostics(builtin, tool, ["file_id"])
