"""Queries over row-wise projections, scoring, gates and data quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions import text
from verdigris.operators import digests, projections, quality, scoring
from verdigris.operators.sifting import sift
from verdigris.plans.bindings import (
    ATTEMPTS_SQL,
    FILES_SQL,
    LINES_SQL,
    MESSAGES_SQL,
    REVIEWS_SQL,
    SPANS_SQL,
    TEXT_FINDINGS_SQL,
    USERS_SQL,
    Tables,
    with_views,
)
from verdigris.plans.registry import query
from verdigris.session import settle

NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(
    "normalize_evidence",
    with_views(FILES_SQL, LINES_SQL) + f"SELECT file_id, line, {NORMAL.format('text')} AS evidence FROM lines",
)
def _(t: Tables):
    return t.lines.select("file_id", "line", text.normalize_evidence("text").alias("evidence"))


@query(
    "fingerprints",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL)
    + f"""
    SELECT finding_id, sha256(lower(path) || chr(31) || lower(rule_id) || chr(31) || '' || chr(31) || {NORMAL.format('evidence')}) AS fingerprint
    FROM text_findings""",
)
def _(t: Tables):
    none = F.lit(None).cast("string")
    key = text.fingerprint(F.col("path"), F.col("file_id").cast("string"), F.col("rule_id"), none, F.col("evidence"))
    return t.text_findings.select("finding_id", key.alias("fingerprint"))


ANCHORS_SQL = f"""anchors AS (
  SELECT finding_id, review_id, source, severity, sha256(lower(path) || chr(31) || lower(rule_id) || chr(31) || anchor) AS fingerprint FROM (
    SELECT finding_id, review_id, source, severity, path, rule_id, {NORMAL.format('evidence')} AS anchor FROM text_findings
    UNION SELECT finding_id, review_id, source, severity, path, rule_id,
      coalesce(array_to_string(list_transform(lines[start_line:end_line], lambda x: {NORMAL.format('x')}), ' '), '') FROM text_findings)
  WHERE anchor <> '')"""


@query(
    "anchor_fingerprints",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, ANCHORS_SQL)
    + "SELECT finding_id, review_id, fingerprint FROM anchors",
)
def _(t: Tables):
    return projections.anchor_fingerprints(t.text_findings, t.files)


TREE_SQL = """
    , counted AS (SELECT review_id, item, count(*) AS n FROM items GROUP BY ALL),
    leaves AS (
      SELECT review_id, substr(sha256(item), 1, 3) AS bucket, sha256(string_agg(item || chr(31) || n, chr(31) ORDER BY item || chr(31) || n)) AS leaf
      FROM counted GROUP BY ALL)
    SELECT review_id, sha256(string_agg(bucket || ':' || leaf, chr(31) ORDER BY bucket)) AS {0} FROM leaves GROUP BY review_id"""


@query(
    "repo_revision",
    with_views(FILES_SQL, "items AS (SELECT review_id, path || ':' || sha256(content) AS item FROM files)") + TREE_SQL.format("revision"),
)
def _(t: Tables):
    return digests.repo_revision(t.files.withColumn("sha256", F.sha2("content", 256)))


@query(
    "artifact_key",
    with_views(
        REVIEWS_SQL,
        SPANS_SQL,
        """items AS (
          SELECT review_id, 'file:' || file_id || ':' || sha256(min(finding_id)) AS item FROM spans GROUP BY review_id, file_id
          UNION ALL SELECT review_id, 'revision:' || finding_id || ':' || sha256(finding_id) || ':' FROM spans WHERE severity = 'low'
          UNION ALL SELECT review_id, 'decision:' || finding_id || ':' || severity FROM spans WHERE severity IN ('low', 'info')
          UNION ALL SELECT review_id, 'audit:' || finding_id || ':decided:' || severity || ':' || start_line FROM spans WHERE severity = 'info'
          UNION ALL SELECT review_id, 'status:' || status FROM reviews)""",
    )
    + TREE_SQL.format("artifact_key"),
)
def _(t: Tables):
    spans = t.spans
    files = spans.groupBy("review_id", "file_id").agg(F.sha2(F.min("finding_id"), 256).alias("sha256"))
    revisions = spans.where("severity = 'low'").select(
        "review_id", F.col("finding_id").alias("revision_id"), F.sha2("finding_id", 256).alias("after_sha256"), F.lit(None).alias("undone_at")
    )
    decisions = spans.where("severity in ('low', 'info')").select("review_id", "finding_id", F.col("severity").alias("decision"))
    audits = spans.where("severity = 'info'").select(
        "review_id", "finding_id", F.lit("decided").alias("action"), F.col("severity").alias("decision"), F.col("start_line").alias("created_at")
    )
    return digests.artifact_key(files, revisions, decisions, audits, t.reviews)


@query(
    "source_kind",
    with_views(SPANS_SQL)
    + """
    SELECT finding_id, CASE WHEN source = 'static' THEN 'deterministic_fact' WHEN end_line <= 30 AND confidence >= 0.7 THEN 'verified_hypothesis'
      ELSE 'model_hypothesis' END AS source_kind FROM spans""",
)
def _(t: Tables):
    flagged = t.spans.withColumns({"range_valid": F.col("end_line") <= 30, "evidence_matched": F.col("confidence") >= 0.7})
    return scoring.source_kind(flagged).select("finding_id", "source_kind")


def drafts(t: Tables, *also: str):
    """Drafts with risk factors; their evidence is text of the documents. ``also`` keeps columns of the findings."""
    pick = lambda column, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))
    return t.text_findings.select(
        "finding_id", "review_id", "file_id", "start_line", "end_line", "rule_id", "evidence", "confidence", "severity",
        F.when(F.col("supplier_id") % 10 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("file"),
        pick("part_id", "code_quality/naming", "security", "logic", "style", "security").alias("category"),
        pick(
            "supplier_id", "Possible SQL injection", "Remote code execution", "Unused import found", "short",
            "Wrong result for empty input", "存在风险", "May consider an edge case", "literal_eval or eval( misuse",
        ).alias("title"),
        F.lit("impact text").alias("impact"),
        F.lit("suggestion text").alias("suggestion"),
        pick("start_line", "low", "medium", "high", "critical").alias("impact_level"),
        pick("supplier_id", "low", "medium", "high").alias("exploitability"),
        pick("part_id", "local", "unknown", "internal", "authenticated", "internet").alias("exposure"),
        *also,
    )


def drafts_with_parts(t: Tables):
    """Drafts with the part of every finding of their id: a draft whose id several findings have stands with each of their parts.

    An id that stands once is its own finding, so only drafts of the other ids are joined. Those are told by hashes alone.
    """
    own = drafts(t, "part_id").withColumn("id_hash", F.xxhash64("finding_id"))
    hashes = t.text_findings.select(F.xxhash64("finding_id").alias("id_hash"))
    repeated = settle(hashes.groupBy("id_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id_hash"), "repeated-ids")
    if repeated.isEmpty():
        return own
    parts = sift(own.select("id_hash", "finding_id", "part_id"), repeated, ["id_hash"]).select("finding_id", "part_id")
    met = sift(own.drop("part_id"), repeated, ["id_hash"]).join(parts, "finding_id")
    return sift(own, repeated, ["id_hash"], keep=False).unionByName(met)


DRAFTS_SQL = """drafts AS (
  SELECT finding_id, review_id, file_id, start_line, end_line, rule_id, evidence, confidence, severity, lines,
    CASE WHEN supplier_id % 10 = 0 THEN path || '.gone' ELSE path END AS file,
    ['code_quality/naming', 'security', 'logic', 'style', 'security'][part_id % 5 + 1] AS category,
    ['Possible SQL injection', 'Remote code execution', 'Unused import found', 'short', 'Wrong result for empty input', '存在风险',
     'May consider an edge case', 'literal_eval or eval( misuse'][supplier_id % 8 + 1] AS title,
    ['low', 'medium', 'high', 'critical'][start_line % 4 + 1] AS impact_level,
    ['low', 'medium', 'high'][supplier_id % 3 + 1] AS exploitability,
    ['local', 'unknown', 'internal', 'authenticated', 'internet'][part_id % 5 + 1] AS exposure,
    supplier_id, part_id
  FROM text_findings)"""


@query(
    "score_risk",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, DRAFTS_SQL)
    + r"""
    , factors AS (
      SELECT finding_id, lower(rule_id || ' ' || category || ' ' || title || ' ' || evidence || ' impact text') AS text, category,
        impact_level = 'critical' AND exploitability = 'high' AS worst,
        CAST(round((2 * (start_line % 4 + 1) + 2 * (supplier_id % 3 + 1) + [0, 1, 1, 2, 3][part_id % 5 + 1]) / 17 * 100) AS INTEGER) AS s FROM drafts),
    branch AS (
      SELECT *, CASE WHEN category IN ('code_quality/naming', 'style') OR regexp_matches(text, 'unused import|unused variable|lint|magic number|未使用|命名|格式|注释|风格|可读性|可维护|重复代码') THEN 'quality'
        WHEN contains(text, 'remote code execution') AND worst THEN 'critical_boundary' WHEN contains(text, 'remote code execution') THEN 'boundary'
        WHEN regexp_matches(text, 'sql injection|ssrf|path traversal|stored xss') THEN 'attack_pattern' ELSE 'factors' END AS severity_basis FROM factors)
    SELECT finding_id, severity_basis,
      CASE severity_basis WHEN 'quality' THEN 'info' WHEN 'critical_boundary' THEN 'critical'
        WHEN 'boundary' THEN CASE WHEN s >= 70 THEN 'critical' ELSE 'high' END
        WHEN 'attack_pattern' THEN CASE WHEN s >= 85 THEN 'critical' WHEN s >= 45 THEN 'high' ELSE 'medium' END
        ELSE CASE WHEN s >= 85 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 40 THEN 'medium' WHEN s >= 20 THEN 'low' ELSE 'info' END END AS severity,
      CASE severity_basis WHEN 'quality' THEN least(s, 20) WHEN 'critical_boundary' THEN greatest(s, 85) WHEN 'boundary' THEN s
        WHEN 'attack_pattern' THEN greatest(s, CASE WHEN s >= 85 THEN 85 WHEN s >= 45 THEN 60 ELSE 45 END) ELSE s END AS risk_score
    FROM branch""",
)
def _(t: Tables):
    return scoring.score_risk(drafts(t)).select("finding_id", "severity_basis", "severity", "risk_score")


@query(
    "cap_severity",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, DRAFTS_SQL)
    + r"""
    SELECT finding_id, CASE WHEN severity IN ('critical', 'high') AND NOT regexp_matches(lower(title || ' ' || evidence), 'eval\(|exec\(|sql injection|command injection')
      THEN 'medium' ELSE severity END AS severity FROM drafts""",
)
def _(t: Tables):
    return scoring.cap_severity(drafts(t)).select("finding_id", "severity")


@query(
    "gate_drafts",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, DRAFTS_SQL)
    + r"""
    SELECT finding_id, CASE WHEN file LIKE '%.gone' THEN 'unknown_file' WHEN end_line > greatest(1, len(lines)) THEN 'range_outside_file'
      WHEN title = '存在风险' THEN 'generic_title' WHEN length(title) < 6 THEN 'short_title'
      WHEN contains(lower(evidence), 'literal_eval(') THEN 'literal_eval_confusion'
      WHEN regexp_matches(lower(title || ' ' || evidence), 'unused import|undefined name|syntax error|compiler error') THEN 'deterministic_claim' ELSE 'passes' END AS gate
    FROM drafts""",
)
def _(t: Tables):
    files = t.files.select("review_id", "path", F.size(text.split_lines("content")).alias("line_count"))
    return scoring.gate_drafts(drafts(t), files).select("finding_id", F.coalesce("gate_reason", F.lit("passes")).alias("gate"))


@query(
    "gate_drafts_semantic",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, DRAFTS_SQL)
    + r"""
    , marked AS (SELECT *, regexp_matches(lower(title || ' impact text suggestion text ' || evidence), ' may | could |consider|edge case|other type') AS speculative FROM drafts)
    SELECT finding_id, CASE WHEN part_id % 11 = 0 THEN 'already_compliant' WHEN part_id % 2 = 1 AND speculative THEN 'speculative_finding'
      WHEN part_id % 2 = 1 OR part_id % 3 = 0 THEN 'root_cause_unverified' ELSE 'verified' END AS verdict_code FROM marked""",
)
def _(t: Tables):
    claimed = drafts_with_parts(t).withColumns(
        {
            "naming_code": F.when(F.col("part_id") % 11 == 0, "already_compliant"),
            "has_bool_fallback": F.lit(False),
            "has_root_cause": F.col("part_id") % 2 == 0,
            "affected_path": F.when(F.col("part_id") % 3 != 0, F.col("file")).otherwise("elsewhere"),
        }
    )
    return scoring.gate_drafts_semantic(claimed).select("finding_id", "verdict_code")


def commented_files(t: Tables):
    kind = F.col("file_id") % 3
    python = F.col("language").isin("en", "es")
    content = (
        F.when(python & (kind == 1), F.concat(F.lit("# head\n\n"), "content"))
        .when(~python & (kind == 1), F.concat(F.lit("// note\n  /* one */ /* two\n"), "content", F.lit("\n*/ tail\n")))
        .when(~python & (kind == 2), F.concat(F.lit("/* a */ code\nx /* not at the start\n"), "content"))
        .otherwise(F.col("content"))
    )
    return t.files.select("file_id", F.when(python, "python").otherwise("cpp").alias("language"), content.alias("content"))


@query(
    "significant_lines",
    with_views(FILES_SQL, LINES_SQL)
    + """
    , marked AS (SELECT *, language IN ('en', 'es') AS py, file_id % 3 AS kind, trim(text) AS body FROM lines),
    shifted AS (
      SELECT file_id, line + CASE WHEN kind = 1 OR (kind = 2 AND NOT py) THEN 2 ELSE 0 END AS line FROM marked
      WHERE body <> '' AND NOT (py AND body LIKE '#%') AND NOT (NOT py AND (kind = 1 OR body LIKE '//%')))
    SELECT * FROM shifted
    UNION ALL SELECT file_id, len(lines) + 3 FROM files WHERE language NOT IN ('en', 'es') AND file_id % 3 = 1
    UNION ALL SELECT file_id, unnest([1, 2]) FROM files WHERE language NOT IN ('en', 'es') AND file_id % 3 = 2""",
)
def _(t: Tables):
    return projections.significant_lines(commented_files(t))


@query(
    "estimate_tokens",
    with_views(FILES_SQL)
    + """
    SELECT file_id, CAST(greatest(1, ceil(strlen(content) / 2)) AS INTEGER) AS tokens, CAST(greatest(1, length(content) // 3) + 512 AS INTEGER) AS request_tokens FROM files""",
)
def _(t: Tables):
    return t.files.select(
        "file_id",
        text.estimate_tokens("content").alias("tokens"),
        text.estimate_request_tokens(F.length("content"), 512).alias("request_tokens"),
    )


@query(
    "route_followup",
    with_views(MESSAGES_SQL)
    + """
    SELECT context_key, turn, CASE WHEN contains(content, '?') THEN 'answer' WHEN context_key % 4 IN (0, 2) THEN 'fix_candidate' ELSE 'answer' END AS route FROM messages""",
)
def _(t: Tables):
    kind = F.col("context_key") % 4
    asked = t.messages.withColumn(
        "content",
        F.when(kind == 0, F.concat(F.lit("删除变量 x "), "content"))
        .when(kind == 1, F.concat(F.lit("不要删除 "), "content"))
        .when(kind == 2, F.concat(F.lit("请把 foo 替换成 "), "content"))
        .otherwise(F.col("content")),
    )
    return projections.route_followup(asked).select("context_key", "turn", "route")


@query(
    "migrate_decisions",
    with_views(SPANS_SQL)
    + """
    SELECT finding_id, CASE severity WHEN 'critical' THEN 'fixed' WHEN 'high' THEN 'accepted_risk' ELSE severity END AS decision FROM spans""",
)
def _(t: Tables):
    old = F.when(F.col("severity") == "critical", "apply").when(F.col("severity") == "high", "keep").otherwise(F.col("severity"))
    return projections.migrate_decisions(t.spans.select("finding_id", old.alias("decision")))


@query("scope_owner", with_views(REVIEWS_SQL) + "SELECT review_id, owner_id, status FROM reviews WHERE owner_id = 7")
def _(t: Tables):
    return projections.scope_owner(t.reviews, 7).select("review_id", "owner_id", "status")


@query(
    "halve_chunks",
    with_views(FILES_SQL)
    + """
    , nodes AS (
      SELECT file_id, file_id || ':0' AS chunk_id, CAST(NULL AS VARCHAR) AS parent_chunk_id, 1 AS start_line, CAST(len(lines) AS INTEGER) AS end_line, lines,
        sha256(content) AS digest, 0 AS depth FROM files
      UNION ALL
      SELECT file_id, chunk_id || '.' || side, chunk_id, first, first + CAST(len(part) AS INTEGER) - 1, part,
        sha256(digest || ':' || first || ':' || (first + len(part) - 1) || ':' || rtrim(array_to_string(part, chr(10)), chr(10))), depth + 1
      FROM (
        SELECT n.*, side, CASE side WHEN 1 THEN start_line ELSE start_line + CAST(len(lines) // 2 AS INTEGER) END AS first,
          CASE side WHEN 1 THEN lines[:len(lines) // 2] ELSE lines[len(lines) // 2 + 1:] END AS part
        FROM nodes n, (SELECT unnest([1, 2]) AS side)
        WHERE depth < 3 AND len(lines) >= 2 AND ceil(strlen(array_to_string(lines, chr(10))) / 2) > 400))
    SELECT file_id, chunk_id, parent_chunk_id, start_line, end_line, digest AS content_fingerprint, depth AS split_depth FROM nodes
    WHERE NOT (depth < 3 AND len(lines) >= 2 AND ceil(strlen(array_to_string(lines, chr(10))) / 2) > 400)""",
)
def _(t: Tables):
    return projections.halve_chunks(projections.file_chunks(t.files), token_budget=400).drop("lines")


@query(
    "excerpt",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL)
    + """
    , raw AS (
      SELECT finding_id, array_to_string(list_transform(range(greatest(1, start_line - 1), least(len(lines), end_line + 1) + 1), lambda i: i || ': ' || lines[i]), chr(10)) AS body
      FROM text_findings)
    SELECT finding_id, CASE WHEN length(body) > 1200 THEN body[:1200] || chr(10) || '…' ELSE body END AS excerpt FROM raw""",
)
def _(t: Tables):
    return projections.excerpt(t.text_findings, t.files, margin=1, max_chars=1200)


@query(
    "redact_revisions",
    with_views(REVIEWS_SQL) + "SELECT review_id, status, amount FROM reviews",
)
def _(t: Tables):
    full = t.reviews.select(
        "review_id", "owner_id", "status", "amount", F.col("priority").alias("before_content"), F.col("priority").alias("diff")
    )
    return projections.redact(full)


@query(
    "broken_rules",
    with_views(SPANS_SQL)
    + """
    SELECT finding_id, array_to_string(list_filter([
      CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_in_unit_range' END,
      CASE WHEN end_line < start_line OR (end_line = start_line AND end_column < start_column) THEN 'end_not_before_start' END,
      CASE WHEN start_line < 4 THEN 'line_past_header' END, CASE WHEN severity = 'info' THEN 'severity_matters' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM spans""",
)
def _(t: Tables):
    rules = {
        **quality.finding_rules(),
        "line_past_header": F.col("start_line") >= 4,
        "severity_matters": F.col("severity") != "info",
    }
    return quality.broken_rules(t.spans, rules).select("finding_id", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "chunk_rule_counts",
    with_views(SPANS_SQL)
    + """
    , broken AS (SELECT unnest(list_filter([
        CASE WHEN start_line % 7 = 0 THEN 'end_not_before_start' END, CASE WHEN part_id % 5 = 0 THEN 'hash_well_formed' END, CASE WHEN part_id % 4 = 0 THEN 'language_known' END,
        CASE WHEN part_id % 9 = 0 THEN 'split_depth_not_negative' END, CASE WHEN severity = 'info' THEN 'status_known' END, CASE WHEN part_id % 6 = 0 THEN 'target_path_present' END], lambda x: x IS NOT NULL)) AS rule FROM spans)
    SELECT rule, count(*) AS rows FROM broken GROUP BY rule""",
)
def _(t: Tables):
    """Findings as chunks, each field of which is wrong now and then."""
    part = F.col("part_id")
    chunks = t.spans.select(
        F.col("finding_id").cast("string").alias("chunk_id"), F.col("review_id").cast("string").alias("review_id"), F.col("file_id").cast("string").alias("target_file_id"),
        F.when(part % 6 == 0, "").otherwise("a.py").alias("target_path"), F.when(part % 4 == 0, "java").otherwise("cpp").alias("language"),
        F.col("start_line").alias("target_start_line"), F.when(F.col("start_line") % 7 == 0, F.col("start_line") - 1).otherwise(F.col("end_line")).alias("target_end_line"),
        F.when(part % 5 == 0, F.upper(F.sha2("finding_id", 256))).otherwise(F.sha2("finding_id", 256)).alias("content_fingerprint"),
        F.lit(None).cast("int").alias("prompt_tokens_estimate"), F.lit(0).alias("output_tokens_budget"), F.when(part % 9 == 0, -1).otherwise(1).alias("split_depth"),
        F.lit(0).alias("attempt_count"), F.when(F.col("severity") == "info", "lost").otherwise("queued").alias("status"),
    )
    return quality.rule_counts(quality.broken_rules(chunks, quality.chunk_rules()))


@query(
    "schema_problems",
    """SELECT 'missing column sha256' AS problem, 0 AS rows UNION ALL SELECT 'unexpected column lang', 0 UNION ALL SELECT 'n_chars is bigint, expected int', 0
    UNION ALL SELECT 'repeated key', count(*) FROM (SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'null key', count(*) FROM documents WHERE source IS NULL OR lang IS NULL HAVING count(*) > 0""",
)
def _(t: Tables):
    """The documents held against a schema that they don't quite have, and against keys that they don't have at all."""
    expected = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.IntegerType()), T.StructField("sha256", T.StringType()),
    ])
    return quality.schema_problems(t.raw("documents"), expected, ["source", "lang"])


@query(
    "rule_counts",
    with_views(SPANS_SQL)
    + """
    SELECT 'line_past_header' AS rule, count(*) AS rows FROM spans WHERE start_line < 4
    UNION ALL SELECT 'severity_matters', count(*) FROM spans WHERE severity = 'info'""",
)
def _(t: Tables):
    rules = {"line_past_header": F.col("start_line") >= 4, "severity_matters": F.col("severity") != "info"}
    return quality.rule_counts(quality.broken_rules(t.spans, rules))


@query(
    "orphans",
    with_views(SPANS_SQL, FILES_SQL)
    + "SELECT finding_id, part_id FROM spans WHERE part_id NOT IN (SELECT file_id FROM files)",
)
def _(t: Tables):
    return quality.orphans(t.spans.select("finding_id", "part_id"), t.files, "part_id", "file_id").select("finding_id", "part_id")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Tables):
    return quality.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "backfill_owner",
    with_views(REVIEWS_SQL, USERS_SQL)
    + "SELECT review_id, CASE WHEN status = 'failed' THEN 0 ELSE owner_id END AS owner_id FROM reviews",
)
def _(t: Tables):
    old = t.reviews.select("review_id", F.when(F.col("status") != "failed", F.col("owner_id")).alias("owner_id"))
    return quality.backfill_owner(old, 0)


@query(
    "import_inconsistencies",
    with_views(SPANS_SQL, REVIEWS_SQL)
    + """
    , selected AS (SELECT DISTINCT review_id, 'f' || supplier_id AS path FROM spans WHERE source = 'llm'),
    files AS (SELECT review_id, 'f' || supplier_id AS path, max(start_line) + 20 AS line_count FROM spans WHERE severity <> 'info' GROUP BY ALL),
    ranges AS (SELECT review_id, 'f' || supplier_id AS path, end_line FROM spans WHERE rule_id = 'rule.A')
    SELECT review_id, path, 'selected_without_file' AS problem FROM selected WHERE (review_id, path) NOT IN (SELECT (review_id, path) FROM files)
    UNION ALL SELECT DISTINCT review_id, path, 'range_of_unselected_path' FROM ranges WHERE (review_id, path) NOT IN (SELECT (review_id, path) FROM selected)
    UNION ALL SELECT DISTINCT review_id, path, 'range_beyond_file' FROM ranges JOIN files USING (review_id, path) WHERE end_line > line_count""",
)
def _(t: Tables):
    path = F.concat(F.lit("f"), F.col("supplier_id").cast("string")).alias("path")
    selected = t.spans.where("source = 'llm'").select("review_id", path).distinct()
    files = t.spans.where("severity <> 'info'").groupBy("review_id", path).agg((F.max("start_line") + 20).alias("line_count"))
    ranges = t.spans.where("rule_id = 'rule.A'").select("review_id", path, "end_line")
    return quality.import_inconsistencies(selected, files, ranges)
