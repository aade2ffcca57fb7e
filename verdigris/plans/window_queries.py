"""Queries over order-dependent operators and set folds."""

from pyspark.sql import functions as F

from verdigris.operators import circuit, projections, sets, windows
from verdigris.plans.bindings import (
    ATTEMPTS_SQL,
    EVENTS_SQL,
    FILES_SQL,
    MESSAGES_SQL,
    PATHS_SQL,
    REVIEWS_SQL,
    SPANS_SQL,
    TEXT_FINDINGS_SQL,
    USERS_SQL,
    Tables,
    with_views,
)
from verdigris.plans.interval_queries import CHUNKS_SQL, chunks
from verdigris.plans.join_queries import REVISIONS_SQL, current_files, revisions
from verdigris.plans.projection_queries import ANCHORS_SQL
from verdigris.plans.registry import query

NUMBERED_SQL = """numbered AS (SELECT event_id, review_id, row_number() OVER (PARTITION BY review_id ORDER BY ts, event_id) AS sequence FROM log)"""
STORED_UNTIL = "2024-01-12"


@query(
    "sequence_events",
    with_views(EVENTS_SQL, NUMBERED_SQL)
    + f"SELECT n.* FROM numbered n JOIN log USING (event_id) WHERE ts >= TIMESTAMP '{STORED_UNTIL}'",
)
def _(t: Tables):
    cut = F.lit(STORED_UNTIL).cast("timestamp")
    stored = t.events.where(F.col("ts") < cut).groupBy("review_id").agg(F.count(F.lit(1)).alias("last_sequence"))
    return windows.sequence_events(t.events.where(F.col("ts") >= cut), stored).select("event_id", "review_id", "sequence")


def numbered_events(t: Tables):
    none = t.events.groupBy("review_id").agg(F.lit(0).alias("last_sequence"))
    return windows.sequence_events(t.events, none)


@query(
    "events_after",
    with_views(EVENTS_SQL, NUMBERED_SQL)
    + "SELECT * FROM numbered WHERE sequence > CASE WHEN review_id % 3 = 0 THEN 0 ELSE review_id END",
)
def _(t: Tables):
    cursors = t.events.where("review_id % 3 <> 0").select("review_id", F.col("review_id").alias("cursor")).distinct()
    return windows.events_after(numbered_events(t), cursors).select("event_id", "review_id", "sequence")


@query(
    "keep_last_n",
    with_views(EVENTS_SQL)
    + "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, event_id DESC) AS n FROM log) WHERE n <= 20",
)
def _(t: Tables):
    return windows.keep_last_n(t.events, ["review_id"], ["ts", "event_id"], windows.KEEP_REVISIONS).select("event_id")


@query(
    "keep_candidates",
    with_views(SPANS_SQL)
    + """
    , a AS (SELECT finding_id, supplier_id % 10 AS owner_id, created_at, row_number() OVER (PARTITION BY supplier_id % 10, part_id % 50 ORDER BY created_at DESC, finding_id DESC) AS n FROM spans)
    SELECT candidate_id, owner_id FROM (SELECT finding_id AS candidate_id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, finding_id DESC) AS m FROM a WHERE n <= 8) WHERE m <= 20""",
)
def _(t: Tables):
    candidates = t.spans.select(
        F.col("finding_id").alias("candidate_id"), (F.col("supplier_id") % 10).alias("owner_id"), (F.col("part_id") % 50).alias("review_id"), "created_at"
    )
    return windows.keep_candidates(candidates).select("candidate_id", "owner_id")


@query(
    "context_keys",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL)
    + """
    SELECT finding_id, CASE WHEN source = 'static' THEN 'finding:' || finding_id WHEN severity = 'info' THEN 'review'
      ELSE 'selection:' || file_id || ':' || start_line || ':' || end_line || ':' || substr(sha256(evidence), 1, 16) END AS context_key FROM text_findings""",
)
def _(t: Tables):
    model = F.col("source") != "static"
    key = windows.context_key(
        F.when(~model, F.col("finding_id")), F.when(F.col("severity") != "info", F.col("file_id")), F.col("start_line"), F.col("end_line"), F.col("evidence")
    )
    return t.text_findings.select("finding_id", key.alias("context_key"))


@query(
    "conversation_context",
    with_views(MESSAGES_SQL)
    + """
    , recent AS (SELECT *, row_number() OVER (PARTITION BY context_key ORDER BY turn DESC) AS n FROM messages),
    joined AS (SELECT context_key, count(*) AS messages, string_agg(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || content, chr(10) ORDER BY turn) AS body FROM recent WHERE n <= 8 GROUP BY context_key)
    SELECT context_key, messages, CASE WHEN length(body) > 6000 THEN '…较早内容已省略…' || chr(10) || right(body, 6000) ELSE body END AS context FROM joined""",
)
def _(t: Tables):
    return windows.conversation_context(t.messages, ["context_key"], ["turn"])


FIT_SQL = """targets AS (SELECT file_id AS chunk_id, content AS target_code, path AS target_path, len(lines) AS target_end_line FROM files),
  refs AS (
    SELECT part_id % (SELECT count(*) FROM documents) AS chunk_id, supplier_id % 4 AS rank, 'p' || supplier_id AS path, start_line, end_line, repeat(finding_id, 12) AS code, finding_id FROM spans),
  base AS (SELECT chunk_id, 2048 + greatest(1, ceil(strlen(target_code) / 2)) + 32 AS base_tokens FROM targets),
  costed AS (
    SELECT r.*, greatest(1, ceil(strlen(path || ':' || start_line || '-' || end_line || code) / 2)) + 32 AS cost,
      row_number() OVER w AS position, sum(greatest(1, ceil(strlen(path || ':' || start_line || '-' || end_line || code) / 2)) + 32) OVER w AS used
    FROM refs r WINDOW w AS (PARTITION BY chunk_id ORDER BY rank, path, start_line, end_line, code)),
  kept AS (SELECT * FROM costed JOIN base USING (chunk_id) WHERE base_tokens + used + 512 <= 11776),
  decided AS (
    SELECT b.chunk_id, CASE WHEN base_tokens + 512 > 11776 THEN 'split_target' WHEN coalesce(k.n, 0) < coalesce(o.n, 0) THEN 'trim_context' ELSE 'fits' END AS action,
      coalesce(k.n, 0) AS kept_refs, CAST(base_tokens + coalesce(k.cost, 0) AS BIGINT) AS prompt_tokens,
      CAST(CASE WHEN base_tokens + 512 > 11776 THEN 0 ELSE least(32768, 11776 - base_tokens - coalesce(k.cost, 0)) END AS BIGINT) AS output_tokens
    FROM base b LEFT JOIN (SELECT chunk_id, count(*) AS n, sum(cost) AS cost FROM kept GROUP BY 1) k USING (chunk_id) LEFT JOIN (SELECT chunk_id, count(*) AS n FROM refs GROUP BY 1) o USING (chunk_id))"""


def fitted(t: Tables):
    targets = t.files_with_lines.select(
        F.col("file_id").alias("chunk_id"), F.col("content").alias("target_code"), F.col("path").alias("target_path"),
        F.lit(1).alias("target_start_line"), F.size("lines").alias("target_end_line"),
    )
    refs = t.spans.select(
        t.file_of_part.alias("chunk_id"), (F.col("supplier_id") % 4).alias("rank"), F.concat(F.lit("p"), F.col("supplier_id").cast("string")).alias("path"),
        "start_line", "end_line", F.repeat("finding_id", F.lit(12)).alias("code"),
    )
    return targets, refs


@query(
    "fit_context",
    with_views(FILES_SQL, SPANS_SQL, FIT_SQL) + "SELECT * FROM decided",
)
def _(t: Tables):
    targets, refs = fitted(t)
    decided, _ = windows.fit_context(targets, refs, context_tokens=12800)
    return decided.select("chunk_id", "action", "kept_refs", "prompt_tokens", "output_tokens")


@query(
    "build_prompts",
    with_views(FILES_SQL, SPANS_SQL, FIT_SQL)
    + """
    SELECT t.chunk_id, output_tokens AS max_output_tokens, 'TARGET_CODE [' || target_path || ':1-' || target_end_line || ']' || chr(10) || target_code || chr(10) || chr(10) || 'CONTEXT_REFERENCES' || chr(10)
      || coalesce(context, '无') || chr(10) || chr(10) || 'RESPONSE_SCHEMA' || chr(10) || '{}' AS prompt
    FROM targets t JOIN decided USING (chunk_id) LEFT JOIN (
      SELECT chunk_id, string_agg('[' || path || ':' || start_line || '-' || end_line || ']' || chr(10) || code, chr(10) || chr(10) ORDER BY position) AS context FROM kept GROUP BY chunk_id) USING (chunk_id)
    WHERE action <> 'split_target'""",
)
def _(t: Tables):
    targets, refs = fitted(t)
    decided, kept = windows.fit_context(targets, refs, context_tokens=12800)
    return projections.build_prompts(decided, kept, "review the target", "{}").select("chunk_id", "max_output_tokens", "prompt")


DECISIONS_SQL = """decision_log AS (
  SELECT review_id, part_id % 40 AS finding_id, CASE WHEN severity = 'info' THEN 'reopened' ELSE 'decided' END AS action,
    CASE severity WHEN 'critical' THEN 'fixed' WHEN 'high' THEN 'accepted_risk' WHEN 'medium' THEN 'deferred' ELSE 'dismissed' END AS decision, created_at, finding_id AS log_id
  FROM (SELECT * REPLACE (supplier_id % 20 AS review_id) FROM spans))"""


def decision_log(t: Tables):
    severity = F.col("severity")
    decision = F.when(severity == "critical", "fixed").when(severity == "high", "accepted_risk").when(severity == "medium", "deferred").otherwise("dismissed")
    return t.spans.select(
        (F.col("supplier_id") % 20).alias("review_id"), (F.col("part_id") % 40).alias("finding_id"),
        F.when(severity == "info", "reopened").otherwise("decided").alias("action"), decision.alias("decision"), "created_at", F.col("finding_id").alias("log_id"),
    )


@query(
    "latest_decision",
    with_views(SPANS_SQL, DECISIONS_SQL)
    + """
    SELECT review_id, finding_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY review_id, finding_id ORDER BY created_at DESC, log_id DESC) AS n FROM decision_log)
    WHERE n = 1 AND action <> 'reopened'""",
)
def _(t: Tables):
    return windows.latest_decision(decision_log(t)).select("review_id", "finding_id", "decision")


@query(
    "ignored_fingerprints",
    with_views(SPANS_SQL, DECISIONS_SQL)
    + """
    , anchors AS (SELECT unnest(range(0, 40)) AS finding_id),
    touched AS (SELECT d.*, sha256(CAST(f AS VARCHAR)) AS fingerprint FROM decision_log d JOIN (SELECT finding_id, finding_id // 2 AS f FROM anchors UNION ALL SELECT finding_id, 1000 + finding_id FROM anchors) USING (finding_id))
    SELECT review_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY review_id, fingerprint ORDER BY created_at DESC, log_id DESC) AS n FROM touched)
    WHERE n = 1 AND action <> 'reopened' AND decision IN ('accepted_risk', 'dismissed')""",
)
def _(t: Tables):
    log = decision_log(t)
    marks = F.array(F.floor(F.col("finding_id") / 2), F.col("finding_id") + 1000)
    marked = log.select("finding_id").distinct().select("finding_id", F.explode(marks).alias("mark"))
    anchors = marked.select("finding_id", F.sha2(F.col("mark").cast("string"), 256).alias("fingerprint"))
    return windows.ignored_fingerprints(log, anchors)


@query(
    "next_before_text",
    with_views(SPANS_SQL, REVIEWS_SQL, REVISIONS_SQL)
    + """
    , retained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY created_at DESC, revision_id DESC) AS n FROM revisions) WHERE n <= 20)
    SELECT r.revision_id, CASE WHEN undone_at IS NULL THEN coalesce(lead(before_content) OVER (PARTITION BY r.review_id, r.file_id ORDER BY created_at, revision_id), content) END AS after_content
    FROM retained r LEFT JOIN current c USING (review_id, file_id)""",
)
def _(t: Tables):
    retained = windows.keep_last_n(revisions(t), ["review_id"], ["created_at", "revision_id"], windows.KEEP_REVISIONS)
    return windows.next_before_text(retained, current_files(t)).select("revision_id", "after_content")


@query(
    "undoable_revision",
    with_views(SPANS_SQL, REVIEWS_SQL, REVISIONS_SQL)
    + """
    SELECT review_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY created_at DESC, revision_id DESC) AS n FROM revisions WHERE undone_at IS NULL)
    JOIN current USING (review_id, file_id) WHERE n = 1 AND content = before_content""",
)
def _(t: Tables):
    files = current_files(t).withColumn("sha256", F.sha2("content", 256))
    return windows.undoable_revision(revisions(t).withColumnRenamed("before_sha256", "after_sha256"), files).select("review_id", "revision_id")


OUTCOME_SQL = """outcomes AS (
  SELECT endpoint, attempt_id, started_at AS at, CASE event WHEN 'view' THEN 'neutral' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS outcome,
    row_number() OVER (PARTITION BY endpoint ORDER BY started_at, attempt_id) AS rn FROM attempts)"""


@query(
    "failure_streaks",
    with_views(
        ATTEMPTS_SQL,
        OUTCOME_SQL,
        """circuit AS (
          SELECT endpoint, attempt_id, rn, CASE outcome WHEN 'failed' THEN 1 ELSE 0 END AS streak, CAST(NULL AS TIMESTAMP) AS opened FROM outcomes WHERE rn = 1
          UNION ALL
          SELECT o.endpoint, o.attempt_id, o.rn, CASE outcome WHEN 'ok' THEN 0 WHEN 'failed' THEN c.before + 1 ELSE c.before END,
            CASE outcome WHEN 'ok' THEN NULL WHEN 'failed' THEN CASE WHEN c.before + 1 >= 3 THEN o.at END ELSE c.was END
          FROM outcomes o JOIN (SELECT endpoint, rn, streak, opened FROM circuit) p ON o.endpoint = p.endpoint AND o.rn = p.rn + 1,
          LATERAL (SELECT CASE WHEN p.opened IS NOT NULL AND o.at - p.opened > INTERVAL 2400 SECOND THEN 0 ELSE p.streak END AS before,
                          CASE WHEN p.opened IS NOT NULL AND o.at - p.opened > INTERVAL 2400 SECOND THEN NULL ELSE p.opened END AS was) c)""",
    )
    + "SELECT endpoint, attempt_id, streak, opened IS NOT NULL AS circuit_open FROM circuit",
)
def _(t: Tables):
    return circuit.failure_streaks(outcomes(t), cooldown_seconds=2400)


def outcomes(t: Tables):
    outcome = F.when(F.col("event") == "view", "neutral").when(F.col("event") == "purchase", "ok").otherwise("failed")
    return t.attempts.select("endpoint", "attempt_id", "started_at", outcome.alias("outcome"))


@query(
    "rate_limit",
    with_views(EVENTS_SQL)
    + """
    , tries AS (SELECT event_id AS attempt_id, 'user' || review_id % 40 AS username, event_id % 2 AS source, ts AS moment, event = 'purchase' AS succeeded FROM log),
    cleared AS (SELECT *, max(CASE WHEN succeeded THEN moment END) OVER (PARTITION BY username, source ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM tries)
    SELECT c.attempt_id, count(f.attempt_id) AS recent_failures, count(f.attempt_id) < 3 AS allowed
    FROM cleared c LEFT JOIN tries f ON f.username = c.username AND f.source = c.source AND NOT f.succeeded AND f.moment < c.moment AND f.moment > c.moment - INTERVAL 90000 SECOND AND f.moment >= coalesce(c.since, f.moment)
    GROUP BY c.attempt_id""",
)
def _(t: Tables):
    tries = t.events.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.when(F.col("event_id") % 3 == 0, "USER").otherwise("user"), (F.col("review_id") % 40).cast("string")).alias("username"),
        (F.col("event_id") % 2).alias("source"), F.col("ts").alias("at"), (F.col("event") == "purchase").alias("succeeded"),
    )
    return windows.rate_limit(tries, allowed=3, window_seconds=90000).select("attempt_id", "recent_failures", "allowed")


LEASES_SQL = """leases AS (SELECT endpoint, attempt_id, started_at, started_at + to_milliseconds(latency_ms) AS ended_at, tokens AS prompt, tokens * 2 AS total FROM attempts),
  steps AS (
    SELECT endpoint, moment, change, attempt_id, sum(change) OVER w AS requests, sum(change * prompt) OVER w AS p, sum(change * total) OVER w AS t FROM (
      SELECT endpoint, attempt_id, started_at AS moment, 1 AS change, prompt, total FROM leases UNION ALL SELECT endpoint, attempt_id, ended_at, -1, prompt, total FROM leases)
    WINDOW w AS (PARTITION BY endpoint ORDER BY moment, change, attempt_id ROWS UNBOUNDED PRECEDING))"""


def leases(t: Tables):
    return t.attempts.select(
        "endpoint", F.col("attempt_id").alias("lease_id"), "started_at",
        F.timestamp_micros(F.unix_micros("started_at") + F.col("latency_ms") * 1000).alias("ended_at"),
        F.col("tokens").alias("prompt_tokens"), (F.col("tokens") * 2).alias("total_tokens"),
    )


@query(
    "concurrency",
    with_views(ATTEMPTS_SQL, LEASES_SQL)
    + "SELECT endpoint, attempt_id AS lease_id, change, CAST(requests AS BIGINT) AS requests, CAST(p AS BIGINT) AS prompt_in_flight, CAST(t AS BIGINT) AS total_in_flight FROM steps",
)
def _(t: Tables):
    return windows.concurrency(leases(t)).drop("at")


@query(
    "concurrency_profile",
    with_views(ATTEMPTS_SQL, LEASES_SQL)
    + """
    SELECT endpoint, CAST(max(requests) AS BIGINT) AS peak_requests, CAST(max(p) AS BIGINT) AS peak_prompt, CAST(max(t) AS BIGINT) AS peak_total,
      max(requests) > 2 OR max(p) > 180 OR max(t) > 400 AS breached FROM steps GROUP BY endpoint""",
)
def _(t: Tables):
    return windows.concurrency_profile(leases(t), 2, 180, 400)


@query(
    "judge_budget",
    with_views(SPANS_SQL)
    + "SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY supplier_id ORDER BY start_line, finding_id) AS n FROM spans WHERE source = 'llm') WHERE n <= 8",
)
def _(t: Tables):
    return windows.judge_budget(t.spans.withColumn("review_id", F.col("supplier_id")), ["start_line", "finding_id"]).select("finding_id")


@query(
    "apply_judgements",
    with_views(SPANS_SQL)
    + """
    , judged AS (SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY supplier_id ORDER BY start_line, finding_id) AS n FROM spans WHERE source = 'llm') WHERE n <= 8)
    SELECT finding_id FROM spans WHERE NOT (finding_id IN (SELECT finding_id FROM judged) AND (severity = 'info' OR confidence < 0.7))""",
)
def _(t: Tables):
    findings = t.spans.withColumn("review_id", F.col("supplier_id"))
    verdicts = windows.judge_budget(findings, ["start_line", "finding_id"]).select("finding_id", (F.col("severity") != "info").alias("accepted"), "confidence")
    return windows.apply_judgements(findings, verdicts).select("finding_id")


@query(
    "single_session",
    with_views(REVIEWS_SQL)
    + "SELECT user_id, session_id FROM (SELECT owner_id AS user_id, review_id AS session_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, review_id DESC) AS n FROM reviews) WHERE n = 1",
)
def _(t: Tables):
    return windows.single_session(t.reviews.select(F.col("review_id").alias("session_id"), F.col("owner_id").alias("user_id"), "created_at")).select("user_id", "session_id")


@query(
    "round_robin",
    with_views(EVENTS_SQL, NUMBERED_SQL)
    + """
    SELECT n.event_id, sequence AS turn FROM numbered n JOIN (SELECT review_id, min(ts) AS first FROM log GROUP BY 1) USING (review_id) ORDER BY sequence, first LIMIT 500""",
)
def _(t: Tables):
    return windows.round_robin(t.events, "review_id", ["ts", "event_id"], 500).select("event_id", "turn")


@query(
    "chunk_statements",
    with_views(SPANS_SQL)
    + """
    , statements AS (SELECT supplier_id AS file_id, part_id * 1000000 + amount % 1000000 AS ord, start_line, end_line, severity = 'critical' AS def FROM spans),
    seen AS (SELECT *, sum(def::INT) OVER (PARTITION BY file_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM statements),
    grouped AS (SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, min(ord) AS first FROM seen GROUP BY file_id, s, CASE WHEN def THEN ord ELSE -1 END)
    SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY first) - 1 AS chunk_index, start_line, end_line FROM grouped""",
)
def _(t: Tables):
    statements = t.spans.select(
        F.col("supplier_id").alias("file_id"), (F.col("part_id") * 1000000 + F.col("amount") % 1000000).alias("ord"), "start_line", "end_line",
        (F.col("severity") == "critical").alias("is_definition"),
    )
    return windows.chunk_module(statements)


@query("page_reviews", with_views(REVIEWS_SQL) + "SELECT review_id FROM reviews ORDER BY created_at DESC, review_id DESC LIMIT 25 OFFSET 50")
def _(t: Tables):
    return windows.page_reviews(t.reviews, 25, 50).select("review_id")


@query(
    "page_users",
    with_views(USERS_SQL)
    + "SELECT user_id, username FROM users WHERE is_active AND contains(lower(username), 'r#00000') ORDER BY role = 'user', lower(username), user_id LIMIT 20 OFFSET 20",
)
def _(t: Tables):
    return windows.page_users(t.users, "R#00000", "active", page=2, page_size=20).select("user_id", "username")


@query("recoverable", with_views(REVIEWS_SQL) + "SELECT review_id, owner_id FROM reviews WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def _(t: Tables):
    return windows.recoverable(t.reviews).select("review_id", "owner_id")


@query(
    "reset_chunks",
    with_views(SPANS_SQL, REVIEWS_SQL, CHUNKS_SQL)
    + """
    SELECT chunk_id, CASE WHEN c.status IN ('queued', 'running', 'validating', 'failed') THEN 'pending' ELSE c.status END AS status
    FROM chunks c JOIN reviews r ON r.review_id = c.file_id WHERE r.status = 'failed'""",
)
def _(t: Tables):
    return windows.reset_chunks(chunks(t).withColumnRenamed("file_id", "review_id"), t.reviews, also_failed=True).select("chunk_id", "status")


@query(
    "sharing_hash",
    with_views(FILES_SQL, SPANS_SQL, TEXT_FINDINGS_SQL, ANCHORS_SQL)
    + """
    SELECT DISTINCT finding_id FROM anchors WHERE source = 'llm' AND fingerprint IN (SELECT fingerprint FROM anchors WHERE source = 'static')""",
)
def _(t: Tables):
    anchors = lambda source: projections.anchor_fingerprints(t.text_findings.where(F.col("source") == source), t.files)
    return sets.sharing_hash(anchors("llm"), anchors("static"), ["fingerprint"]).select("finding_id").distinct()


@query(
    "ordered_distinct",
    with_views(PATHS_SQL)
    + """
    SELECT review_id, host, row_number() OVER (PARTITION BY review_id ORDER BY first) AS position FROM (
      SELECT review_id, regexp_extract(path, '^[^/]*') AS host, min(page_id) AS first FROM paths GROUP BY ALL)""",
)
def _(t: Tables):
    hosts = t.paths.withColumn("host", F.regexp_extract("path", "^[^/]*", 0))
    return sets.ordered_distinct(hosts, ["review_id"], "host", "page_id")


@query(
    "set_differences",
    with_views(PATHS_SQL)
    + r"""
    , l AS (SELECT DISTINCT regexp_extract(path, '/([^?#]*)', 1) AS path FROM paths WHERE page_id % 2 = 0),
    r AS (SELECT DISTINCT regexp_extract(path, '/([^?#]*)', 1) AS path FROM paths WHERE page_id % 2 = 1)
    SELECT path, 'left' AS only_in FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT path, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""",
)
def _(t: Tables):
    inner = t.paths.select("page_id", F.regexp_extract("path", "/([^?#]*)", 1).alias("path"))
    return sets.set_differences(inner.where("page_id % 2 = 0"), inner.where("page_id % 2 = 1"), ["path"])
