"""Queries over line intervals."""

from pyspark.sql import functions as F

from verdigris.operators import intervals, projections
from verdigris.plans.bindings import FILES_SQL, LINES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, Tables, with_views
from verdigris.plans.registry import query

CHUNKS_SQL = """chunks AS (
  SELECT finding_id AS chunk_id, file_id, start_line AS target_start_line, end_line AS target_end_line,
         CASE severity WHEN 'info' THEN 'superseded' WHEN 'low' THEN 'failed' WHEN 'medium' THEN 'running' WHEN 'high' THEN 'pending' ELSE 'completed' END AS status
  FROM spans WHERE rule_id = 'rule.A')"""


def chunks(t: Tables):
    severity = F.col("severity")
    status = (
        F.when(severity == "info", "superseded").when(severity == "low", "failed").when(severity == "medium", "running")
        .when(severity == "high", "pending").otherwise("completed")
    )
    return t.spans.where("rule_id = 'rule.A'").select(
        F.col("finding_id").alias("chunk_id"), "file_id", F.col("start_line").alias("target_start_line"),
        F.col("end_line").alias("target_end_line"), status.alias("status"),
    )


@query(
    "findings_in_chunks",
    with_views(SPANS_SQL, CHUNKS_SQL)
    + """
    SELECT finding_id, chunk_id FROM spans s JOIN chunks c ON s.file_id = c.file_id AND start_line >= target_start_line AND end_line <= target_end_line""",
)
def _(t: Tables):
    return intervals.findings_in_chunks(t.spans, chunks(t)).select("finding_id", "chunk_id")


@query(
    "overlapping_findings",
    with_views(SPANS_SQL)
    + """
    SELECT a.finding_id, count(*) - 1 AS overlapping FROM spans a JOIN spans b ON a.file_id = b.file_id AND a.start_line <= b.end_line AND b.start_line <= a.end_line
    GROUP BY a.finding_id""",
)
def _(t: Tables):
    return intervals.overlap_counts(t.spans).select("finding_id", "overlapping")


MERGED_SQL = """merged AS (
  SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line FROM (
    SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY start_line, end_line, finding_id) AS island FROM (
      SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                     THEN 0 ELSE 1 END AS opens FROM short))
  GROUP BY file_id, island)"""
SHORT_SQL = "short AS (SELECT finding_id, file_id, start_line * 8 AS start_line, start_line * 8 + supplier_id % 10 AS end_line FROM spans)"


def short_spans(t: Tables):
    return t.spans.select(
        "finding_id", "file_id", (F.col("start_line") * 8).alias("start_line"),
        (F.col("start_line") * 8 + F.col("supplier_id") % 10).cast("int").alias("end_line"),
    )


@query("merge_ranges", with_views(SPANS_SQL, SHORT_SQL, MERGED_SQL) + "SELECT * FROM merged")
def _(t: Tables):
    return intervals.merge_ranges(short_spans(t).drop("finding_id"), ["file_id"])


@query(
    "in_review_scope",
    with_views(SPANS_SQL)
    + """
    , placed AS (SELECT finding_id, review_id, file_id, start_line, end_line, CASE WHEN supplier_id % 9 = 0 THEN 'python.syntax-error' ELSE rule_id END AS rule_id,
       CASE WHEN supplier_id % 7 <> 0 THEN 'p' || supplier_id % 4 END AS path FROM spans),
    ranges AS (SELECT review_id, 'p' || supplier_id % 4 AS path, end_line AS start_line, end_line + 1 AS end_line FROM spans WHERE source = 'static')
    SELECT finding_id FROM placed p WHERE review_id % 3 = 0 OR (path IS NOT NULL AND (path NOT IN ('p0', 'p1', 'p2') OR review_id % 3 = 1 OR rule_id = 'python.syntax-error'
      OR EXISTS (SELECT 1 FROM ranges r WHERE r.review_id = p.review_id AND r.path = p.path AND p.start_line <= r.end_line + 2 AND p.end_line >= greatest(1, r.start_line - 2))))""",
)
def _(t: Tables):
    path = F.concat(F.lit("p"), (F.col("supplier_id") % 4).cast("string"))
    rule = F.when(F.col("supplier_id") % 9 == 0, "python.syntax-error").otherwise(F.col("rule_id"))
    findings = t.spans.select("finding_id", "review_id", F.col("supplier_id").alias("file_id"), "start_line", "end_line", rule.alias("rule_id"))
    files = t.spans.where("supplier_id % 7 <> 0").select("review_id", F.col("supplier_id").alias("file_id"), path.alias("path"))
    scopes = t.reviews.where("review_id % 3 <> 0").select(
        "review_id", F.array(*[F.lit(f"p{at}") for at in range(3)]).alias("selected_paths"), (F.col("review_id") % 3 == 2).alias("has_ranges")
    )
    ranges = t.spans.where("source = 'static'").select(
        "review_id", path.alias("path"), F.col("end_line").alias("start_line"), (F.col("end_line") + 1).alias("end_line")
    )
    return intervals.in_review_scope(findings, files, scopes, ranges).select("finding_id")


@query(
    "enclosing_symbol",
    with_views(SPANS_SQL)
    + """
    , points AS (SELECT DISTINCT file_id, start_line AS line FROM spans WHERE source = 'llm'),
    symbols AS (SELECT file_id, finding_id AS symbol, amount AS ord, start_line, end_line FROM spans WHERE source = 'static')
    SELECT p.file_id, p.line, arg_min(symbol, (end_line - start_line) * 1000000000000 + ord) AS symbol
    FROM points p JOIN symbols s ON p.file_id = s.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY p.file_id, p.line""",
)
def _(t: Tables):
    points = t.spans.where("source = 'llm'").select("file_id", F.col("start_line").alias("line"))
    symbols = t.spans.where("source = 'static'").select(
        "file_id", F.col("finding_id").alias("symbol"), F.col("amount").alias("ord"), "start_line", "end_line"
    )
    return intervals.enclosing_symbol(points, symbols)


@query(
    "line_annotations",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL)
    + """
    , touched AS (SELECT *, unnest(range(start_line, least(end_line, len(lines)) + 1)) AS line FROM text_findings),
    sized AS (SELECT *, length(lines[line]) AS n, CASE WHEN line = start_line THEN start_column - 1 ELSE 0 END AS s FROM touched)
    SELECT finding_id, line, least(s, n) AS start_char,
      least(greatest(CASE WHEN line = end_line THEN greatest(s + 1, end_column - 1) ELSE n END, s + 1), n) AS end_char FROM sized""",
)
def _(t: Tables):
    return intervals.line_annotations(t.text_findings, t.files)


@query(
    "locate_evidence",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL)
    + r"""
    , quoted AS (SELECT *, trim(evidence, ' ' || chr(10)) AS quote, lines[start_line:end_line] AS part FROM text_findings WHERE end_line <= len(lines)),
    kept AS (
      SELECT *, list_position(list_transform(part, lambda x: contains(x, quote)), true) AS whole_at, trim(string_split(quote, chr(10))[1]) AS first, trim(string_split(quote, chr(10))[-1]) AS last,
        length(quote) - length(replace(quote, chr(10), '')) AS breaks
      FROM quoted WHERE quote <> '' AND contains(trim(regexp_replace(array_to_string(part, ' '), '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g')))),
    placed AS (
      SELECT *, CASE WHEN whole_at > 0 THEN start_line + whole_at - 1
        ELSE start_line - 1 + list_filter(range(1, len(part) + 1), lambda a: contains(part[a], first) AND contains(part[least(len(part), a + breaks)], last))[1] END AS f FROM kept),
    ended AS (SELECT *, CASE WHEN whole_at > 0 THEN f ELSE least(end_line, f + breaks) END AS e FROM placed WHERE f IS NOT NULL)
    SELECT finding_id, CAST(f AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line,
      CASE WHEN whole_at > 0 THEN instr(lines[f], quote) ELSE instr(lines[f], first) END AS start_column,
      CASE WHEN whole_at > 0 THEN instr(lines[f], quote) + length(quote) ELSE instr(lines[e], last) + length(last) END AS end_column
    FROM ended""",
)
def _(t: Tables):
    located = intervals.locate_evidence(t.text_findings, t.files)
    return located.select("finding_id", "start_line", "start_column", "end_line", "end_column")


# Up to four edits per file, well apart.
EDITS_SQL = """edits AS (
  SELECT file_id, 3 + 12 * CAST(part_id % 4 AS INTEGER) AS fix_start, 3 + 12 * CAST(part_id % 4 AS INTEGER) + CAST(min(supplier_id) % 5 AS INTEGER) AS fix_end,
    CAST(max(supplier_id) % 6 AS INTEGER) AS new_lines
  FROM spans WHERE severity IN ('critical', 'high') GROUP BY file_id, part_id % 4),
  sized AS (SELECT *, new_lines - (fix_end - fix_start + 1) AS delta FROM edits)"""


def edits(t: Tables):
    first = 3 + 12 * F.col("slot")
    return (
        t.spans.where("severity in ('critical', 'high')").withColumn("slot", (F.col("part_id") % 4).cast("int"))
        .groupBy("file_id", "slot")
        .agg((F.min("supplier_id") % 5).cast("int").alias("length"), (F.max("supplier_id") % 6).cast("int").alias("new_lines"))
        .select("file_id", first.alias("fix_start"), (first + F.col("length")).alias("fix_end"), "new_lines")
    )


@query(
    "shift_findings",
    with_views(SPANS_SQL, EDITS_SQL)
    + """
    SELECT finding_id, CAST(start_line + coalesce(sum(delta) FILTER (fix_end < start_line), 0) AS INTEGER) AS start_line,
      CAST(end_line + coalesce(sum(delta) FILTER (fix_end < start_line), 0) AS INTEGER) AS end_line
    FROM spans s LEFT JOIN sized e USING (file_id) GROUP BY finding_id, start_line, end_line
    HAVING count(*) FILTER (fix_start <= end_line AND fix_end >= start_line) = 0""",
)
def _(t: Tables):
    return intervals.shift_spans(t.spans, edits(t), ["file_id"]).select("finding_id", "start_line", "end_line")


@query(
    "shift_ranges",
    with_views(SPANS_SQL, EDITS_SQL)
    + """
    , met AS (
      SELECT finding_id, start_line, end_line, coalesce(sum(delta) FILTER (fix_end < start_line), 0) AS above,
        coalesce(sum(delta) FILTER (fix_start <= end_line AND fix_end >= start_line), 0) AS inside,
        min(fix_start) FILTER (fix_start <= end_line AND fix_end >= start_line) AS top,
        max(fix_start + greatest(1, new_lines) - 1 - delta) FILTER (fix_start <= end_line AND fix_end >= start_line) AS bottom
      FROM spans s LEFT JOIN sized e USING (file_id) GROUP BY finding_id, start_line, end_line)
    SELECT finding_id, CAST(above + least(start_line, coalesce(top, start_line)) AS INTEGER) AS start_line,
      CAST(above + inside + greatest(end_line, coalesce(bottom, end_line)) AS INTEGER) AS end_line FROM met""",
)
def _(t: Tables):
    return intervals.shift_spans(t.spans, edits(t), ["file_id"], on_overlap="widen").select("finding_id", "start_line", "end_line")


LINE_EDITS_SQL = """line_edits AS (
  SELECT l_partkey % (SELECT count(*) FROM documents) AS file_id, min(l_linenumber) AS start_line, min(l_linenumber) + 1 AS end_line, 'new text' || chr(10) || min(l_suppkey) AS replacement FROM lineitem GROUP BY 1
  UNION ALL SELECT l_partkey % (SELECT count(*) FROM documents), 20, 20, '' FROM lineitem GROUP BY 1)"""


@query(
    "apply_line_edits",
    with_views(FILES_SQL, LINES_SQL, LINE_EDITS_SQL)
    + """
    , kept AS (
      SELECT file_id, line, text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM line_edits e WHERE e.file_id = l.file_id AND l.line BETWEEN e.start_line AND e.end_line)
      UNION ALL SELECT e.file_id, e.start_line, e.replacement FROM line_edits e JOIN files USING (file_id) WHERE replacement <> '')
    SELECT file_id, sha256(string_agg(text, chr(10) ORDER BY line)) AS sha256 FROM kept GROUP BY file_id""",
)
def _(t: Tables):
    file_id = (F.col("l_partkey") % t.n_files).alias("file_id")
    lines = t.raw("lineitem").groupBy(file_id)
    first = F.min("l_linenumber")
    changes = lines.agg(
        first.alias("start_line"), (first + 1).alias("end_line"),
        F.concat(F.lit("new text\n"), F.min("l_suppkey").cast("string")).alias("replacement"),
    ).unionByName(
        t.raw("lineitem").select(file_id).distinct().select(
            "file_id", F.lit(20).alias("start_line"), F.lit(20).alias("end_line"), F.lit("").alias("replacement")
        )
    )
    return intervals.apply_line_edits(t.files, changes).select("file_id", "sha256")


@query(
    "line_coverage",
    with_views(FILES_SQL, LINES_SQL, SPANS_SQL)
    + """
    , required AS (SELECT file_id, line FROM lines WHERE trim(text) <> '' AND trim(text) NOT LIKE '#%'),
    spans2 AS (SELECT part_id % (SELECT count(*) FROM documents) AS file_id, start_line, least(start_line + supplier_id % 2, end_line) AS end_line FROM spans WHERE severity <> 'info'),
    marked AS (SELECT r.*, EXISTS (SELECT 1 FROM spans2 s WHERE s.file_id = r.file_id AND r.line BETWEEN s.start_line AND s.end_line) AS hit FROM required r)
    SELECT file_id, count(*) AS required, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) * 100.0 / count(*) AS percent,
      min(line) FILTER (NOT hit) AS first_missing_line, coalesce(string_agg(line, ',' ORDER BY line) FILTER (NOT hit), '') AS missing_lines FROM marked GROUP BY file_id""",
)
def _(t: Tables):
    significant = projections.significant_lines(t.files.withColumn("language", F.lit("python")))
    leaves = t.spans.select(
        t.file_of_part.alias("file_id"), F.col("start_line").alias("target_start_line"),
        F.least(F.col("start_line") + F.col("supplier_id") % 2, "end_line").alias("target_end_line"),
        F.when(F.col("severity") == "info", "superseded").otherwise("completed").alias("status"),
    )
    return intervals.line_coverage(significant, leaves).withColumn("missing_lines", F.array_join("missing_lines", ","))


@query(
    "parse_error_gate",
    with_views(FILES_SQL, SPANS_SQL)
    + """
    SELECT f.file_id, CAST(sum(greatest(1, end_line - start_line - 10)) AS BIGINT) AS error_bytes, greatest(1, any_value(strlen(content))) AS size,
      sum(greatest(1, end_line - start_line - 10)) / greatest(1, any_value(strlen(content))) > 0.15 AS rejected
    FROM files f JOIN spans s ON s.part_id % (SELECT count(*) FROM documents) = f.file_id GROUP BY f.file_id""",
)
def _(t: Tables):
    errors = t.spans.select(t.file_of_part.alias("file_id"), (F.col("end_line") - F.col("start_line") - 10).alias("error_bytes"))
    return intervals.parse_error_gate(errors, t.files)
