"""Queries over merging and rollups."""

from pyspark.sql import functions as F

from verdigris.operators import aggregates, merging, sets
from verdigris.plans.bindings import (
    ATTEMPTS_SQL,
    FILES_SQL,
    REVIEWS_SQL,
    SPANS_SQL,
    USERS_SQL,
    Tables,
    with_views,
)
from verdigris.plans.interval_queries import CHUNKS_SQL, chunks
from verdigris.plans.join_queries import SYMBOLS_SQL, calls, symbols
from verdigris.plans.registry import query

MERGE_SQL = """ordered AS (
    SELECT *, row_number() OVER (PARTITION BY file_id, rule_id ORDER BY CASE source WHEN 'static' THEN 0 ELSE 1 END, start_line, start_column, finding_id) AS rn FROM spans),
  fold AS (
    SELECT file_id, rule_id, rn, [{'id': finding_id, 's': start_line, 'e': end_line, 'fixed': source = 'static', 'dup': false}] AS kept FROM ordered WHERE rn = 1
    UNION ALL
    SELECT file_id, rule_id, rn, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, {'id': finding_id, 's': start_line, 'e': end_line, 'fixed': source = 'static', 'dup': false})
        ELSE list_transform(kept, lambda x, i: CASE WHEN i <> hit THEN x WHEN x.fixed THEN {'id': x.id, 's': x.s, 'e': x.e, 'fixed': x.fixed, 'dup': true}
          ELSE {'id': finding_id, 's': start_line, 'e': end_line, 'fixed': source = 'static', 'dup': true} END) END
    FROM (SELECT o.*, f.kept, list_position(list_transform(f.kept, lambda x: x.s <= o.end_line AND o.start_line <= x.e), true) AS hit
          FROM fold f JOIN ordered o ON o.file_id = f.file_id AND o.rule_id = f.rule_id AND o.rn = f.rn + 1)),
  survivors AS (
    SELECT k.id AS finding_id, k.dup AS deduplicated FROM (
      SELECT unnest(kept) AS k FROM (SELECT *, max(rn) OVER (PARTITION BY file_id, rule_id) AS last FROM fold) WHERE rn = last))"""


def merged(t: Tables):
    """Spans without symbols, so that identity is the rule and its evidence within a file."""
    return merging.merge_findings(t.spans.withColumn("symbol", F.lit(None).cast("string")))


@query("merge_findings", with_views(SPANS_SQL, MERGE_SQL) + "SELECT finding_id, deduplicated FROM survivors")
def _(t: Tables):
    return merged(t).select("finding_id", "deduplicated")


@query(
    "severity_summary",
    with_views(SPANS_SQL, REVIEWS_SQL, MERGE_SQL)
    + """
    SELECT r.review_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
      count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(s.finding_id) AS total
    FROM reviews r LEFT JOIN (SELECT spans.* FROM spans JOIN survivors USING (finding_id)) s ON s.review_id = r.review_id GROUP BY r.review_id""",
)
def _(t: Tables):
    return aggregates.severity_summary(merged(t), t.reviews)


@query(
    "union_findings",
    with_views(SPANS_SQL) + "SELECT finding_id, CASE source WHEN 'static' THEN 0 ELSE 1 END AS source_rank FROM spans",
)
def _(t: Tables):
    both = merging.union_findings(t.spans.where("source = 'static'"), t.spans.where("source = 'llm'"))
    return both.select("finding_id", "source_rank")


@query(
    "chunk_progress",
    with_views(SPANS_SQL, CHUNKS_SQL)
    + """
    SELECT file_id, count(*) FILTER (status <> 'superseded') AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS queued,
      coalesce(count(*) FILTER (status = 'completed') * 100.0 / nullif(count(*) FILTER (status <> 'superseded'), 0), 100.0) AS percent
    FROM chunks GROUP BY file_id""",
)
def _(t: Tables):
    return aggregates.chunk_progress(chunks(t), "file_id")


GOLDEN_SQL = """expected AS (SELECT DISTINCT 'case-' || doc_id % 7 AS case_id, 'rule.' || doc_id % 3 AS rule_id, 'f' || doc_id // 2 AS path, doc_id % 11 AS line FROM labels WHERE quality = 1),
  actual AS (SELECT DISTINCT 'case-' || doc_id % 7 AS case_id, 'rule.' || doc_id % 3 AS rule_id, 'f' || doc_id // 2 AS path, doc_id % 11 AS line FROM labels WHERE toxic = 0)"""
GOLDEN_KEYS = ["case_id", "rule_id", "path", "line"]


def golden(t: Tables):
    named = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    doc = F.col("doc_id")
    rows = t.raw("labels").select(
        "quality", "toxic", named("case-", doc % 7).alias("case_id"), named("rule.", doc % 3).alias("rule_id"),
        named("f", F.floor(doc / 2)).alias("path"), (doc % 11).alias("line"),
    )
    return rows.where("quality = 1").select(*GOLDEN_KEYS), rows.where("toxic = 0").select(*GOLDEN_KEYS)


@query(
    "golden_metrics",
    with_views(GOLDEN_SQL)
    + """
    , n AS (SELECT (SELECT count(*) FROM (SELECT * FROM expected INTERSECT SELECT * FROM actual)) AS tp,
      (SELECT count(*) FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)) AS fp, (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)) AS fn)
    SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
      fp / (tp + fp) AS false_positive_rate, tp / (tp + fp) AS location_accuracy FROM n""",
)
def _(t: Tables):
    return aggregates.golden_metrics(*golden(t), GOLDEN_KEYS)


@query(
    "golden_rates",
    "SELECT avg(quality) AS candidate_parse_rate, coalesce(avg(toxic) FILTER (toxic > 5), 1.0) AS patch_apply_rate, 1 - avg(toxic) AS regression_rate FROM labels",
)
def _(t: Tables):
    return t.raw("labels").agg(
        aggregates.rate_or_one(F.col("quality") == 1).alias("candidate_parse_rate"),
        aggregates.rate_or_one(F.when(F.col("toxic") > 5, True)).alias("patch_apply_rate"),
        aggregates.rate_or_one(F.col("toxic") == 1, invert=True).alias("regression_rate"),
    )


@query(
    "golden_failures",
    with_views(GOLDEN_SQL)
    + """
    SELECT case_id, case_id || ': ' || kind || ' ' || rule_id || ' at ' || path || ':' || line AS failure FROM (
      SELECT *, 'missing' AS kind FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual) UNION ALL
      SELECT *, 'unexpected' FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected))""",
)
def _(t: Tables):
    return aggregates.golden_failures(*golden(t))


@query("shared_tuples", with_views(GOLDEN_SQL) + "SELECT * FROM expected INTERSECT SELECT * FROM actual")
def _(t: Tables):
    return sets.shared(*golden(t), GOLDEN_KEYS)


@query("missing_tuples", with_views(GOLDEN_SQL) + "SELECT * FROM expected EXCEPT SELECT * FROM actual")
def _(t: Tables):
    return sets.missing(*golden(t), GOLDEN_KEYS)


@query(
    "policy_suggestions",
    with_views(SPANS_SQL) + "SELECT rule_id, count(*) AS dismissed_count FROM spans WHERE severity = 'info' GROUP BY rule_id",
)
def _(t: Tables):
    decision = F.when(F.col("severity") == "info", "dismissed").otherwise("deferred")
    return aggregates.policy_suggestions(t.spans, t.spans.select("finding_id", decision.alias("decision")))


@query(
    "user_stats",
    with_views(USERS_SQL) + "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS disabled FROM users",
)
def _(t: Tables):
    return aggregates.user_stats(t.users)


@query("counter_totals", with_views(ATTEMPTS_SQL) + "SELECT event AS name, CAST(sum(tokens) AS BIGINT) AS total FROM attempts GROUP BY event")
def _(t: Tables):
    return aggregates.counter_totals(t.attempts.select(F.col("event").alias("name"), F.col("tokens").alias("amount")))


@query(
    "cache_ratio",
    with_views(ATTEMPTS_SQL)
    + """
    , s AS (SELECT CAST(sum(tokens) FILTER (event = 'view') AS BIGINT) AS hits, CAST(sum(tokens) FILTER (event = 'click') AS BIGINT) AS misses FROM attempts)
    SELECT hits, misses, hits / (hits + misses) AS hit_ratio FROM s""",
)
def _(t: Tables):
    counters = aggregates.counter_totals(t.attempts.select(F.col("event").alias("name"), F.col("tokens").alias("amount")))
    return aggregates.cache_ratio(counters, "view", "click")


@query(
    "review_shape",
    with_views(FILES_SQL)
    + """
    SELECT review_id, count(*) AS file_count, CAST(sum(greatest(1, len(lines))) AS BIGINT) AS total_lines,
      CAST(sum(greatest(1, ceil(strlen(content) / 2))) AS BIGINT) AS input_tokens, count(*) > 1 AS complex FROM files GROUP BY review_id""",
)
def _(t: Tables):
    return aggregates.review_shape(t.files).drop("mode")


@query(
    "route_model",
    with_views(FILES_SQL)
    + """
    SELECT file_id, CASE WHEN big THEN CASE WHEN file_id % 3 = 0 THEN 'vendor-flash' WHEN file_id % 3 = 1 THEN 'a-pro' ELSE 'base' END
        ELSE CASE WHEN file_id % 3 = 2 THEN 'base' ELSE 'vendor-flash' END END AS model FROM (SELECT file_id, len(lines) >= 500 OR ceil(strlen(content) / 2) >= 12000 AS big FROM files)""",
)
def _(t: Tables):
    kind = F.col("review_id") % 3
    lists = [["vendor-flash", " "], ["vendor-flash", "a-pro", "z-pro "], ["other", "base"]]
    literal = lambda names: F.array(*[F.lit(name) for name in names])
    available = F.when(kind == 0, literal(lists[0])).when(kind == 1, literal(lists[1])).otherwise(literal(lists[2]))
    shape = aggregates.review_shape(t.files.select(F.col("file_id").alias("review_id"), "content"))
    return shape.select(F.col("review_id").alias("file_id"), aggregates.route_model(available, F.col("complex")).alias("model"))


@query(
    "inference_stats",
    with_views(ATTEMPTS_SQL)
    + """
    SELECT endpoint, event, count(*) AS requests, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
      quantile_cont(latency_ms // 2, 0.95) AS first_delta_p95_ms, sum(tokens) * 1000 / sum(latency_ms) AS tokens_per_second,
      count(*) FILTER (ok) * 100 / count(*) AS success_percent FROM attempts GROUP BY endpoint, event""",
)
def _(t: Tables):
    runs = t.attempts.withColumn("first_delta_ms", F.floor(F.col("latency_ms") / 2))
    return aggregates.inference_stats(runs, ["endpoint", "event"])


@query(
    "token_usage",
    with_views(ATTEMPTS_SQL)
    + """
    SELECT endpoint, CAST(sum(tokens) AS BIGINT) AS prompt_tokens, CAST(sum(latency_ms) AS BIGINT) AS completion_tokens, CAST(sum(tokens) FILTER (ok) AS BIGINT) AS cache_hit_tokens,
      CAST(sum(tokens) FILTER (NOT ok) AS BIGINT) AS cache_miss_tokens, sum(tokens) FILTER (ok) / sum(tokens) AS cache_hit_ratio FROM attempts GROUP BY endpoint""",
)
def _(t: Tables):
    runs = t.attempts.select(
        "endpoint", F.col("tokens").alias("prompt_tokens"), F.col("latency_ms").alias("completion_tokens"),
        F.when(F.col("ok"), F.col("tokens")).alias("prompt_cache_hit_tokens"), F.when(~F.col("ok"), F.col("tokens")).alias("prompt_cache_miss_tokens"),
    )
    return aggregates.token_usage(runs, ["endpoint"])


@query(
    "review_failure_cause",
    with_views(ATTEMPTS_SQL)
    + """
    , coded AS (
      SELECT review_id, CASE WHEN ok THEN NULL WHEN tokens % 20 = 0 THEN 'context_overflow' WHEN endpoint >= 6 THEN 'model_error'
          ELSE ['local_model_circuit_open', 'local_model_timeout', 'local_model_connection_refused', 'model_error'][tokens % 4 + 1] END AS error_code,
        CASE WHEN tokens = 7 THEN 'planning_error' WHEN tokens = 8 THEN 'coverage_incomplete' END AS planning FROM attempts),
    per AS (
      SELECT review_id, coalesce(bool_or(error_code = 'context_overflow'), false) AS overflow, max(planning) FILTER (planning <> 'coverage_incomplete') AS planning, max(planning) AS any_planning,
        CASE WHEN bool_or(error_code = 'local_model_circuit_open') THEN 'local_model_circuit_open' WHEN bool_or(error_code = 'local_model_connection_refused') THEN 'local_model_connection_refused'
             WHEN bool_or(error_code = 'local_model_timeout') THEN 'local_model_timeout' END AS local FROM coded GROUP BY review_id)
    SELECT review_id, CASE WHEN overflow THEN 'context_overflow' WHEN planning IS NOT NULL THEN 'planning' WHEN local IS NOT NULL THEN 'local_model' ELSE 'other' END AS cause,
      NOT (overflow OR planning IS NOT NULL) AS retryable, coalesce(local, any_planning, 'review_failed') AS code FROM per""",
)
def _(t: Tables):
    kind = F.when(F.col("ok"), None).when(F.col("tokens") % 20 == 0, "context_overflow").otherwise(
        F.element_at(F.array(*[F.lit(item) for item in ("circuit_open", "timeout", "connection_refused", "bad_output")]), (F.col("tokens") % 4 + 1).cast("int"))
    )
    attempts = t.attempts.select(
        "review_id", kind.alias("error_kind"), F.when(F.col("endpoint") < 6, "local-model").otherwise("hosted").alias("model_profile"),
        F.when(F.col("tokens") == 7, "planning_error").when(F.col("tokens") == 8, "coverage_incomplete").alias("planning_error"),
    )
    return aggregates.review_failure_cause(aggregates.attempt_error_code(attempts))


@query(
    "graph_stats",
    with_views(SYMBOLS_SQL)
    + """
    , edges AS (SELECT review_id, symbol_id, callee, 'call' AS kind FROM calls UNION SELECT review_id, symbol_id, name, 'base' FROM symbols)
    SELECT s.review_id, count(DISTINCT s.symbol_id) AS node_count, (SELECT count(*) FROM edges e WHERE e.review_id = s.review_id) AS edge_count FROM symbols s GROUP BY s.review_id""",
)
def _(t: Tables):
    bases = symbols(t).select("review_id", "symbol_id", F.col("name").alias("base"))
    return aggregates.graph_stats(calls(t), bases, symbols(t))


@query("symbol_degree", with_views(SYMBOLS_SQL) + "SELECT review_id, symbol_id, count(*) AS degree FROM calls GROUP BY ALL")
def _(t: Tables):
    return aggregates.symbol_degree(calls(t))


HISTORY_SQL = (
    with_views(REVIEWS_SQL, SPANS_SQL)
    + """
    , files AS (SELECT DISTINCT review_id, supplier_id AS file_id, 'm' || supplier_id || '.py' AS path FROM spans),
    listed AS (SELECT review_id, count(*) AS n, string_agg(path, chr(10) ORDER BY file_id) AS names, arg_min(path, file_id) AS first FROM files GROUP BY review_id),
    counted AS (SELECT review_id, count(*) AS total FROM spans GROUP BY review_id)
    SELECT r.review_id, CASE WHEN owner_id % 5 = 0 THEN 'my title' WHEN owner_id % 3 = 1 AND first IS NOT NULL THEN first
        WHEN owner_id % 3 = 2 THEN '项目审查 · ' || coalesce(first, '未命名项目') || ' 等 ' || coalesce(n, 0) || ' 个文件'
        ELSE '代码审查 · ' || strftime(created_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END AS title,
      status, coalesce(n, 0) AS file_count, coalesce(names, '') AS file_names, coalesce(total, 0) AS findings
    FROM reviews r LEFT JOIN listed USING (review_id) LEFT JOIN counted USING (review_id)"""
)


def history(t: Tables):
    """Reviews with titles and modes, and their files."""
    owner = F.col("owner_id")
    reviews = t.reviews.withColumns(
        {
            "title": F.when(owner % 5 == 0, "  my title ").otherwise(" "),
            "mode": F.when(owner % 3 == 1, "single").when(owner % 3 == 2, "project").otherwise("paste"),
        }
    )
    files = t.spans.select(
        "review_id", F.col("supplier_id").alias("file_id"), F.concat(F.lit("m"), F.col("supplier_id").cast("string"), F.lit(".py")).alias("path")
    ).distinct()
    return reviews, files


@query("history_items", HISTORY_SQL)
def _(t: Tables):
    reviews, files = history(t)
    return aggregates.history_items(reviews, files, aggregates.severity_summary(t.spans)).drop("mode", "created_at")


@query(
    "history_details",
    f"""SELECT h.*, r.created_at, strftime(r.created_at + INTERVAL 30 DAY, '%Y-%m-%d') AS expires_on, CASE WHEN r.status = 'failed' THEN 'it failed' END AS error,
      CASE owner_id % 3 WHEN 1 THEN 'merge_request' WHEN 2 THEN 'local' END AS origin_kind, coalesce(critical, 0) AS critical, coalesce(info, 0) AS info
    FROM ({HISTORY_SQL}) h JOIN (SELECT o_orderkey AS review_id, o_custkey AS owner_id, o_orderdate AS created_at, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'failed' END AS status FROM orders) r USING (review_id)
    LEFT JOIN ({with_views(SPANS_SQL)} SELECT review_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'info') AS info FROM spans GROUP BY review_id) USING (review_id)""",
)
def _(t: Tables):
    reviews, files = history(t)
    kind = F.when(F.col("owner_id") % 3 == 1, "merge_request").when(F.col("owner_id") % 3 == 2, "local")
    told = reviews.withColumns({
        "expires_at": F.col("created_at") + F.expr("INTERVAL 30 DAYS"),
        "error": F.when(F.col("status") == "failed", "it failed"),
        "origin": F.when(kind.isNotNull(), F.struct(kind.alias("kind"))),
    })
    items = aggregates.history_items(told, files, aggregates.severity_summary(t.spans), details=True)
    return items.select(
        "review_id", "title", "status", "file_count", "file_names", "findings", "created_at", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"), "error",
        F.col("origin.kind").alias("origin_kind"), "critical", "info",
    )


@query(
    "recency_buckets",
    with_views(REVIEWS_SQL)
    + """
    SELECT CASE WHEN d <= 0 THEN 'today' WHEN d <= 6 THEN 'past_7_days' ELSE 'older' END AS bucket, count(*) AS reviews
    FROM (SELECT date_diff('day', CAST(created_at AS DATE), DATE '2000-06-01') AS d FROM reviews) GROUP BY 1""",
)
def _(t: Tables):
    return aggregates.recency_buckets(t.reviews, F.lit("2000-06-01").cast("date"))


@query(
    "analyzer_coverage",
    with_views(FILES_SQL)
    + """
    , runs AS (SELECT review_id, CASE WHEN language IN ('en', 'es') THEN 'python' ELSE 'cpp' END AS language, language <> 'fr' AS available, file_id % 13 = 0 AS failed FROM files)
    SELECT review_id, language, CASE WHEN language = 'cpp' THEN 'compiler' WHEN bool_and(runs.available AND NOT failed) THEN 'linter' ELSE 'python-ast' END AS analyzer,
      (language = 'python' OR bool_and(runs.available AND NOT failed)) AS available, NOT bool_and(runs.available AND NOT failed) AS fallback FROM runs GROUP BY review_id, language""",
)
def _(t: Tables):
    python = F.col("language").isin("en", "es")
    runs = t.files.select(
        "review_id", F.when(python, "python").otherwise("cpp").alias("language"), F.when(python, "linter").otherwise("compiler").alias("analyzer"),
        (F.col("language") != "fr").alias("available"), (F.col("file_id") % 13 == 0).alias("failed"),
    )
    return aggregates.analyzer_coverage(runs)


@query(
    "outcome_breakdown",
    with_views(SPANS_SQL)
    + """
    SELECT rule_id, severity, count(*) FILTER (k = 0) AS fixed, count(*) FILTER (k = 1) AS accepted_risk, count(*) FILTER (k = 2) AS dismissed,
      count(*) FILTER (k = 3) AS deferred, count(*) FILTER (k = 4) AS pending FROM (SELECT *, part_id % 5 AS k FROM spans) GROUP BY rule_id, severity""",
)
def _(t: Tables):
    kind = F.col("part_id") % 5
    names = F.array(*[F.lit(item) for item in ("fixed", "accepted_risk", "dismissed", "deferred")])
    decisions = t.spans.select("finding_id", F.get(names, kind.cast("int")).alias("decision")).where("decision IS NOT NULL")
    return aggregates.outcome_breakdown(t.spans, decisions)
