"""Queries over sinks, exports, governance jobs and extensions."""

from pyspark.sql import functions as F

from verdigris.functions import extensions
from verdigris.operators import aggregates, governance, windows
from verdigris.plans.aggregate_queries import GOLDEN_KEYS, GOLDEN_SQL, golden
from verdigris.plans.bindings import EVENTS_SQL, FILES_SQL, LINES_SQL, REVIEWS_SQL, SPANS_SQL, USERS_SQL, Tables, with_views
from verdigris.plans.join_queries import REVISIONS_SQL, current_files, revisions
from verdigris.plans.registry import query
from verdigris.session import scratch_path
from verdigris.sinks import exports, tables
from verdigris.sinks.keyed import KeyedTable


@query("write_table", with_views(SPANS_SQL) + "SELECT finding_id, severity, source FROM spans")
def _(t: Tables):
    path = scratch_path(t.spark, "findings")
    tables.write_table(t.spans.select("finding_id", "severity", "source"), path, ["severity"])
    return t.spark.read.parquet(path).select("finding_id", "severity", "source")


UPSERT_SQL = """picked AS (SELECT *, row_number() OVER (PARTITION BY review_id, event ORDER BY ts DESC, event_id DESC) AS n FROM {})"""


@query("upsert_latest", with_views(EVENTS_SQL, UPSERT_SQL.format("log")) + "SELECT review_id, event, event_id FROM picked WHERE n = 1")
def _(t: Tables):
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp")
    return tables.upsert_latest(t.events.where(early), t.events.where(~early), ["review_id", "event"], ["ts", "event_id"]).select("review_id", "event", "event_id")


@query("keyed_upsert", with_views(EVENTS_SQL, UPSERT_SQL.format("log")) + "SELECT review_id, event, event_id FROM picked WHERE n = 1")
def _(t: Tables):
    """Seven batches out of order, one of them twice, into buckets that are compacted on the way."""
    rows = t.events.select("review_id", "event", "event_id", "ts")
    table = KeyedTable(t.spark, scratch_path(t.spark, "keyed"), rows.schema, ["review_id", "event"], ["ts", "event_id"], buckets=8, max_deltas=3)
    for number, part in enumerate((3, 0, 6, 1, 5, 2, 4)):
        table.upsert(rows.where(F.col("event_id") % 7 == part), number)
    table.upsert(rows.where(F.col("event_id") % 7 == 5), 4)
    return table.read().select("review_id", "event", "event_id")


@query(
    "upsert_owned",
    with_views(
        EVENTS_SQL,
        """owned AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-03' OR event_id % 4 > 0 THEN review_id ELSE -1 END AS owner_id FROM log),
        known AS (SELECT DISTINCT review_id, event FROM owned WHERE ts < TIMESTAMP '2024-01-03'),
        allowed AS (SELECT * FROM owned WHERE ts < TIMESTAMP '2024-01-03' OR owner_id = review_id OR (review_id, event) NOT IN (SELECT (review_id, event) FROM known))""",
        UPSERT_SQL.format("allowed"),
    )
    + "SELECT review_id, event, event_id FROM picked WHERE n = 1",
)
def _(t: Tables):
    early = F.col("ts") < F.lit("2024-01-03").cast("timestamp")
    owned = t.events.withColumn("owner_id", F.when(early | (F.col("event_id") % 4 > 0), F.col("review_id")).otherwise(-1))
    merged = tables.upsert_owned(owned.where(early), owned.where(~early), ["review_id", "event"], ["ts", "event_id"])
    return merged.select("review_id", "event", "event_id")


@query(
    "replace_partition",
    with_views(SPANS_SQL) + "SELECT finding_id, severity, CASE severity WHEN 'low' THEN 'second' ELSE 'first' END AS run FROM spans WHERE NOT (severity = 'low' AND source = 'llm')",
)
def _(t: Tables):
    path = scratch_path(t.spark, "partitions")
    rows = t.spans.select("finding_id", "severity", "source")
    tables.replace_partition(rows.withColumn("run", F.lit("first")), path, ["severity"])
    again = rows.where("severity = 'low' AND source = 'static'").withColumn("run", F.lit("second"))
    tables.replace_partition(again, path, ["severity"])
    return t.spark.read.parquet(path).select("finding_id", "severity", "run")


REPORT_SQL = """fin AS (
    SELECT *, 'm' || supplier_id || '.py' AS path, ['fixed', 'accepted_risk', 'dismissed', 'deferred', 'pending'][part_id % 5 + 1] AS decision,
      ['fixed', 'accepted_risk', 'dismissed', 'pending', 'pending'][part_id % 5 + 1] AS outcome FROM spans),
  rfiles AS (SELECT DISTINCT review_id, path, sha256(path) AS sha FROM fin),
  counted AS (SELECT review_id, count(*) AS n FROM rfiles GROUP BY 1),
  per AS (SELECT review_id, count(*) FILTER (outcome = 'fixed') AS a, count(*) FILTER (outcome = 'accepted_risk') AS b, count(*) FILTER (outcome = 'dismissed') AS c,
      count(*) FILTER (outcome = 'pending') AS d, count(*) FILTER (severity = 'info') AS h, count(*) FILTER (severity = 'high') AS v FROM fin GROUP BY 1),
  base AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(h, 0) AS h, coalesce(v, 0) AS v
    FROM reviews r LEFT JOIN counted USING (review_id) LEFT JOIN per USING (review_id)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY review_id, outcome ORDER BY path, start_line, finding_id) AS k FROM fin),
  blocks AS (
    SELECT review_id, 0 AS section, '' AS item, concat_ws(chr(10), '# 代码审查报告', '', '- 审查 ID：' || review_id, '- 状态：' || status, '- 创建时间：' || strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '- 文件数：' || n, '', '## 摘要', '', 'priority ' || priority, '', '## 文件', '') AS text FROM base
    UNION ALL SELECT review_id, 1, path, '- `' || path || '`' FROM rfiles
    UNION ALL SELECT review_id, 2, '', concat_ws(chr(10), '', '## 已修复', '', CASE WHEN a = 0 THEN '本次审查没有已确认应用的修复。' END, CASE WHEN a = 0 THEN '' END) FROM base
    UNION ALL SELECT review_id, 4, '', concat_ws(chr(10), '## 接受风险', '', CASE WHEN b = 0 THEN '没有接受风险的问题。' END, CASE WHEN b = 0 THEN '' END) FROM base
    UNION ALL SELECT review_id, 6, '', concat_ws(chr(10), '## 已驳回', '', CASE WHEN c = 0 THEN '没有被判定为不成立的问题。' END, CASE WHEN c = 0 THEN '' END) FROM base
    UNION ALL SELECT review_id, 8, '', concat_ws(chr(10), '## 待处理', '', CASE WHEN d = 0 THEN '没有待处理问题。' END, CASE WHEN d = 0 THEN '' END) FROM base
    UNION ALL SELECT review_id, CASE outcome WHEN 'fixed' THEN 3 WHEN 'accepted_risk' THEN 5 WHEN 'dismissed' THEN 7 ELSE 9 END, lpad(CAST(k AS VARCHAR), 12, '0'),
      concat_ws(chr(10), '### ' || k || '. title ' || rule_id, '', '- 严重度：' || severity, '- 位置：`' || path || ':' || start_line || '-' || end_line || '`', '- 置信度：' || CAST(round(confidence * 100) AS BIGINT) || '%', '',
        '证据：' || evidence, '', '影响：an impact', '', '建议：a suggestion', '') FROM numbered
    UNION ALL SELECT review_id, 10, '', concat_ws(chr(10), '## 处理历史', '', CASE WHEN h = 0 THEN '没有可用的问题处理审计记录。' END) FROM base
    UNION ALL SELECT review_id, 11, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || ' ' || finding_id || ' decided', '- ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || ' · title ' || rule_id || ' · 完成决策（已驳回）'
      || CASE WHEN source = 'static' THEN '；代码修订仍保留' ELSE '' END || '：because' FROM fin WHERE severity = 'info'
    UNION ALL SELECT review_id, 12, '', concat_ws(chr(10), '', '## 文件哈希与验证覆盖', '') FROM base
    UNION ALL SELECT review_id, 13, path, '- `' || path || '`：`' || sha || '`' FROM rfiles
    UNION ALL SELECT review_id, 14, '', concat_ws(chr(10), '', CASE WHEN status <> 'completed' THEN '- 没有可用的静态验证覆盖记录。' END) FROM base
    UNION ALL SELECT review_id, 15, 'python linter', '- python / linter：已覆盖；fine' FROM base WHERE status = 'completed'
    UNION ALL SELECT review_id, 16, '', concat_ws(chr(10), '', '## 修订 Diff', '', CASE WHEN v = 0 THEN '没有生效中的代码修订。' END) FROM base
    UNION ALL SELECT review_id, 17, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000000') || ' ' || finding_id, concat_ws(chr(10), '### ' || path, '', '- 修改前 SHA-256：`' || sha256(evidence) || '`', '- 修改后 SHA-256：`' || sha256(finding_id) || '`',
      '- 修改理由：未提供', '- 验证：ok；checked', '', '```diff', '+' || evidence, '```', '') FROM fin WHERE severity = 'high')"""


@query(
    "report_lines",
    with_views(SPANS_SQL, REVIEWS_SQL, REPORT_SQL)
    + """
    SELECT review_id, section, count(*) AS blocks, CAST(sum(CAST('0x' || substr(sha256(item || '|' || text), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM blocks GROUP BY review_id, section""",
)
def _(t: Tables):
    path = F.concat(F.lit("m"), F.col("supplier_id").cast("string"), F.lit(".py"))
    kind = (F.col("part_id") % 5).cast("int")
    names = F.array(*[F.lit(item) for item in ("fixed", "accepted_risk", "dismissed", "deferred")])
    findings = t.spans.select(
        "review_id", "finding_id", F.col("supplier_id").alias("file_id"), "severity", "start_line", "end_line", "confidence",
        F.concat(F.lit("title "), "rule_id").alias("title"), "evidence", F.lit("an impact").alias("impact"), F.lit("a suggestion").alias("suggestion"),
    )
    # Names and hashes follow from the ids, so only ids are shuffled.
    files = t.spans.select("review_id", "supplier_id").distinct().select(
        "review_id", F.col("supplier_id").alias("file_id"), path.alias("path"), F.sha2(path, 256).alias("sha256")
    )
    decisions = t.spans.select("finding_id", F.get(names, kind).alias("decision")).where("decision IS NOT NULL")
    history = t.spans.where("severity = 'info'").select(
        "review_id", "finding_id", F.lit("decided").alias("action"), F.lit("dismissed").alias("decision"), "created_at", F.lit("because").alias("reason"),
        (F.col("source") == "static").alias("revision_retained"),
    )
    coverage = t.reviews.where("status = 'completed'").select(
        "review_id", F.lit("python").alias("language"), F.lit("linter").alias("analyzer"), F.lit(True).alias("available"), F.lit("fine").alias("message")
    )
    changes = t.spans.where("severity = 'high'").select(
        "review_id", F.col("finding_id").alias("revision_id"), "created_at", path.alias("path"), F.sha2("evidence", 256).alias("before_sha256"),
        F.sha2("finding_id", 256).alias("after_sha256"), F.lit("").alias("explanation"), F.array(F.lit("ok"), F.lit("checked")).alias("validation"),
        F.concat(F.lit("+"), "evidence", F.lit("  ")).alias("diff"), F.lit(None).cast("timestamp").alias("undone_at"),
    )
    reviews = t.reviews.withColumn("summary", F.concat(F.lit("priority "), "priority"))
    lines = exports.report_lines(reviews, files, findings, decisions, history, coverage, changes)
    mark = F.conv(F.substring(F.sha2(F.concat_ws("|", "item", "text"), 256), 1, 8), 16, 10).cast("long")
    return lines.groupBy("review_id", "section").agg(F.count(F.lit(1)).alias("blocks"), F.sum(mark).alias("checksum"))


@query(
    "report_origins",
    """SELECT o_orderkey AS review_id, CASE o_orderkey % 3
      WHEN 0 THEN '## GitLab 来源' || chr(10) || chr(10) || '- 合并请求：[group/app !' || o_custkey || '](https://example.org/' || o_custkey || ')' || chr(10) || '- 基线版本：b' || o_orderkey || chr(10)
        || '- 审查版本：h' || o_orderkey || chr(10) || '- 已选文件：' || o_orderkey % 4 || chr(10)
      WHEN 1 THEN '## 本地版本对比来源' || chr(10) || chr(10) || '- 修改前：v1' || chr(10) || '- 修改后：v2' || chr(10) || '- 已选文件：' || o_orderkey % 4 || chr(10) END AS origin_text FROM orders""",
)
def _(t: Tables):
    key, owner = F.col("review_id").cast("string"), F.col("owner_id").cast("string")
    kind = F.when(F.col("review_id") % 3 == 0, "merge_request").when(F.col("review_id") % 3 == 1, "local").otherwise("paste")
    origins = t.reviews.select(
        "review_id", kind.alias("kind"), F.lit("group/app").alias("project_path"), F.col("owner_id").alias("request_number"),
        F.concat(F.lit("https://example.org/"), owner).alias("request_url"), F.concat(F.lit("b"), key).alias("base_sha"), F.concat(F.lit("h"), key).alias("head_sha"),
        F.lit("v1").alias("old_label"), F.lit("v2").alias("new_label"), F.array_repeat(F.lit("a.py"), (F.col("review_id") % 4).cast("int")).alias("selected_paths"),
    )
    return exports.origin_text(origins)


@query(
    "fixed_files",
    with_views(SPANS_SQL, REVIEWS_SQL, REVISIONS_SQL)
    + """
    SELECT review_id, file_id, 'my-file-' || file_id || '.py' AS download_name FROM current WHERE (review_id, file_id) IN (SELECT (review_id, file_id) FROM revisions WHERE undone_at IS NULL)""",
)
def _(t: Tables):
    files = current_files(t).withColumn("path", F.concat(F.lit("src/my file#"), F.col("file_id").cast("string"), F.lit(".py")))
    return exports.fixed_files(files, revisions(t)).select("review_id", "file_id", "download_name")


@query(
    "metric_table",
    with_views(GOLDEN_SQL)
    + """
    , n AS (SELECT (SELECT count(*) FROM (SELECT * FROM expected INTERSECT SELECT * FROM actual)) AS tp,
      (SELECT count(*) FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)) AS fp, (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)) AS fn)
    SELECT 0 AS position, 'Precision' AS metric, printf('%.3f', tp / (tp + fp)) AS value FROM n UNION ALL SELECT 1, 'Recall', printf('%.3f', tp / (tp + fn)) FROM n
    UNION ALL SELECT 2, 'False-positive rate', printf('%.3f', fp / (tp + fp)) FROM n UNION ALL SELECT 3, 'Location accuracy', printf('%.3f', tp / (tp + fp)) FROM n""",
)
def _(t: Tables):
    return exports.metric_table(aggregates.golden_metrics(*golden(t), GOLDEN_KEYS))


@query(
    "metric_markdown",
    with_views(GOLDEN_SQL)
    + """
    , n AS (SELECT (SELECT count(*) FROM (SELECT * FROM expected INTERSECT SELECT * FROM actual)) AS tp,
      (SELECT count(*) FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)) AS fp, (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)) AS fn),
    wrong AS (SELECT case_id || ': ' || kind || ' ' || rule_id || ' at ' || path || ':' || line AS failure FROM (
      SELECT *, 'missing' AS kind FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)))
    SELECT 0 AS section, '' AS item, '# Golden benchmark: labels' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|---|---:|' AS text
    UNION ALL SELECT 1, '000000', '| Precision | ' || printf('%.3f', tp / (tp + fp)) || ' |' FROM n UNION ALL SELECT 1, '000001', '| Recall | ' || printf('%.3f', tp / (tp + fn)) || ' |' FROM n
    UNION ALL SELECT 1, '000002', '| False-positive rate | ' || printf('%.3f', fp / (tp + fp)) || ' |' FROM n UNION ALL SELECT 1, '000003', '| Location accuracy | ' || printf('%.3f', tp / (tp + fp)) || ' |' FROM n
    UNION ALL SELECT 2, '', chr(10) || '## Failures' || chr(10) UNION ALL SELECT 3, failure, '- ' || failure FROM wrong""",
)
def _(t: Tables):
    table = exports.metric_table(aggregates.golden_metrics(*golden(t), GOLDEN_KEYS))
    return exports.metric_markdown(table, aggregates.golden_failures(*golden(t)), "labels")


DOOMED_SQL = "doomed AS (SELECT review_id FROM reviews WHERE status = 'failed')"


def review_tables(t: Tables):
    return {"reviews": t.reviews, "findings": t.spans, "events": t.events, "users": t.users, "auth_sessions": sessions(t)}


def sessions(t: Tables):
    return t.reviews.select(F.col("review_id").alias("session_id"), F.col("owner_id").alias("user_id"))


def table_sizes(left):
    """How many rows each table keeps, with a checksum of their keys."""
    keys = {"reviews": "review_id", "findings": "amount", "events": "event_id", "users": "user_id", "auth_sessions": "session_id"}
    sizes = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(keys[name]), F.lit(0)).alias("keys")) for name, df in left.items()
    ]
    first, *rest = sizes
    for df in rest:
        first = first.unionByName(df)
    return first


SIZES_SQL = """SELECT 'reviews' AS table_name, count(*) AS rows, CAST(coalesce(sum(review_id), 0) AS BIGINT) AS keys FROM reviews WHERE {r}
    UNION ALL SELECT 'findings', count(*), CAST(sum(amount) AS BIGINT) FROM spans WHERE {f} UNION ALL SELECT 'events', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM log WHERE {e}
    UNION ALL SELECT 'users', count(*), CAST(sum(user_id) AS BIGINT) FROM users WHERE {u} UNION ALL SELECT 'auth_sessions', count(*), CAST(sum(review_id) AS BIGINT) FROM reviews WHERE {s}"""
VIEWS = (REVIEWS_SQL, SPANS_SQL, EVENTS_SQL, USERS_SQL)
OUT = "review_id NOT IN (SELECT review_id FROM doomed)"


@query("cascade_delete", with_views(*VIEWS, DOOMED_SQL) + SIZES_SQL.format(r=OUT, f=OUT, e=OUT, u="true", s="true"))
def _(t: Tables):
    return table_sizes(governance.cascade_delete(review_tables(t), t.reviews.where("status = 'failed'")))


@query("reset_review", with_views(*VIEWS, DOOMED_SQL) + SIZES_SQL.format(r="true", f=OUT, e="true", u="true", s="true"))
def _(t: Tables):
    return table_sizes(governance.reset_review(review_tables(t), t.reviews.where("status = 'failed'")))


WANTED_SQL = "wanted AS (SELECT DISTINCT supplier_id * 3 AS user_id FROM spans), gone AS (SELECT user_id FROM users WHERE role = 'user' AND user_id IN (SELECT user_id FROM wanted)), doomed AS (SELECT review_id FROM reviews WHERE owner_id IN (SELECT user_id FROM gone))"


@query(
    "purge_users",
    with_views(*VIEWS, WANTED_SQL)
    + SIZES_SQL.format(r=OUT, f=OUT, e=OUT, u="user_id NOT IN (SELECT user_id FROM gone)", s="owner_id NOT IN (SELECT user_id FROM gone)"),
)
def _(t: Tables):
    left, _ = governance.purge_users(review_tables(t), t.spans.select((F.col("supplier_id") * 3).alias("user_id")))
    root = scratch_path(t.spark, "purged")
    tables.write_version(left, root, 1)
    return table_sizes(tables.read_version(t.spark, root, list(left)))


@query(
    "purge_buckets",
    with_views(*VIEWS, WANTED_SQL)
    + SIZES_SQL.format(r=OUT, f=OUT, e=OUT, u="user_id NOT IN (SELECT user_id FROM gone)", s="owner_id NOT IN (SELECT user_id FROM gone)"),
)
def _(t: Tables):
    keys = {"reviews": ["review_id"], "findings": ["review_id", "finding_id"], "events": ["review_id", "event_id"], "users": ["user_id"], "auth_sessions": ["user_id", "session_id"]}
    held = {}
    for name, df in review_tables(t).items():
        held[name] = KeyedTable(t.spark, scratch_path(t.spark, f"keyed-{name}"), df.schema, keys[name], keys[name], buckets=8, bucket_by=keys[name][:1])
        held[name].upsert(df)
    governance.purge_users_from(held, t.spans.select((F.col("supplier_id") * 3).alias("user_id")))
    return table_sizes({name: table.read() for name, table in held.items()})


@query(
    "purge_outcome",
    with_views(*VIEWS, WANTED_SQL)
    + "SELECT w.user_id, CASE WHEN role IS NULL THEN 'unknown' WHEN role = 'admin' THEN 'protected' ELSE 'purged' END AS result FROM (SELECT user_id * 2 AS user_id FROM wanted) w LEFT JOIN users USING (user_id)",
)
def _(t: Tables):
    return governance.purge_outcome(t.users, t.spans.select((F.col("supplier_id") * 6).alias("user_id")))


@query(
    "expire_reviews",
    with_views(*VIEWS, "doomed AS (SELECT review_id FROM reviews WHERE status <> 'failed' AND created_at + INTERVAL 30 DAY <= TIMESTAMP '2000-01-01')")
    + SIZES_SQL.format(r=OUT, f=OUT, e=OUT, u="true", s="true"),
)
def _(t: Tables):
    held = review_tables(t)
    held["reviews"] = t.reviews.withColumn("expires_at", F.when(F.col("status") != "failed", F.col("created_at") + F.expr("INTERVAL 30 DAYS")))
    return table_sizes(governance.expire(held, F.lit("2000-01-01").cast("timestamp")))


@query(
    "batch_set_active",
    with_views(SPANS_SQL, USERS_SQL)
    + """
    SELECT user_id, coalesce(role = 'user', false) AS ok, CASE WHEN role IS NULL THEN 'unknown' WHEN role <> 'user' THEN 'protected' END AS error, false AS active
    FROM (SELECT DISTINCT supplier_id * 20 AS user_id FROM spans) LEFT JOIN users USING (user_id)""",
)
def _(t: Tables):
    return governance.batch_set_active(t.users, t.spans.select((F.col("supplier_id") * 20).alias("user_id")), active=False)


@query(
    "apply_activation",
    with_views(SPANS_SQL, USERS_SQL)
    + "SELECT user_id, is_active AND NOT (role = 'user' AND user_id IN (SELECT supplier_id * 20 FROM spans)) AS is_active FROM users",
)
def _(t: Tables):
    results = governance.batch_set_active(t.users, t.spans.select((F.col("supplier_id") * 20).alias("user_id")), active=False)
    return governance.apply_activation(t.users, results).select("user_id", "is_active")


@query(
    "drop_disabled_sessions",
    with_views(SPANS_SQL, USERS_SQL, REVIEWS_SQL)
    + "SELECT review_id AS session_id FROM reviews WHERE owner_id NOT IN (SELECT user_id FROM users WHERE role = 'user' AND user_id IN (SELECT supplier_id * 20 FROM spans))",
)
def _(t: Tables):
    results = governance.batch_set_active(t.users, t.spans.select((F.col("supplier_id") * 20).alias("user_id")), active=False)
    return governance.drop_disabled_sessions(sessions(t), results).select("session_id")


@query(
    "isolation_audit",
    with_views(SPANS_SQL, REVIEWS_SQL)
    + """
    , owned AS (SELECT s.finding_id, CASE WHEN s.supplier_id % 50 = 0 THEN s.review_id + 10000000 ELSE s.review_id END AS review_id, CASE WHEN s.supplier_id % 30 = 1 THEN -1 ELSE owner_id END AS owner_id
      FROM spans s JOIN reviews r USING (review_id))
    SELECT finding_id, CASE WHEN r.review_id IS NULL THEN 'no_review' ELSE 'other_owner' END AS problem FROM owned o LEFT JOIN reviews r ON r.review_id = o.review_id WHERE r.review_id IS NULL OR r.owner_id <> o.owner_id""",
)
def _(t: Tables):
    owners = t.reviews.select("review_id", "owner_id")
    children = t.spans.join(owners, "review_id").select(
        "finding_id", F.when(F.col("supplier_id") % 50 == 0, F.col("review_id") + 10000000).otherwise(F.col("review_id")).alias("review_id"),
        F.when(F.col("supplier_id") % 30 == 1, -1).otherwise(F.col("owner_id")).alias("owner_id"),
    )
    return governance.isolation_audit(children, t.reviews).select("finding_id", "problem")


def long_lines(path: str, content: str):
    """A sample analyzer: lines of more than 400 characters."""
    for at, line in enumerate(content.split("\n"), start=1):
        if len(line) > 400:
            yield ("style.long-line", "warning", at, 401, at, len(line), f"{len(line)} characters")


LONG_SQL = "SELECT file_id, line, length(text) || ' characters' AS message FROM lines WHERE length(text) > 400"


@query("apply_analyzer", with_views(FILES_SQL, LINES_SQL) + LONG_SQL)
def _(t: Tables):
    return extensions.apply_analyzer(t.files, long_lines).select("file_id", "line", "message")


@query("registered_analyzer", with_views(FILES_SQL, LINES_SQL) + LONG_SQL)
def _(t: Tables):
    extensions.register_analyzer(t.spark, "long_lines", long_lines)
    extensions.analyzable(t.files).createOrReplaceTempView("analyzable_files")
    return t.spark.sql("SELECT file_id, d.line, d.message FROM analyzable_files, LATERAL long_lines(path, content) AS d")


@query(
    "judged_findings",
    with_views(SPANS_SQL)
    + """
    , judged AS (SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY supplier_id ORDER BY start_line, finding_id) AS n FROM spans WHERE source = 'llm') WHERE n <= 8)
    SELECT finding_id FROM spans WHERE NOT (finding_id IN (SELECT finding_id FROM judged) AND (rule_id = 'rule.R' OR confidence < 0.7))""",
)
def _(t: Tables):
    def verdicts(findings):
        out = findings[["confidence"]].copy()
        out.insert(0, "accepted", findings["rule_id"] != "rule.R")
        out["reason"] = "rule " + findings["rule_id"]
        return out

    findings = t.spans.withColumn("review_id", F.col("supplier_id"))
    ask = extensions.judge(verdicts)
    judged = windows.judge_budget(findings, ["start_line", "finding_id"]).withColumn("verdict", ask(F.struct("rule_id", "confidence")))
    return windows.apply_judgements(findings, judged.select("finding_id", "verdict.accepted", "verdict.confidence")).select("finding_id")


@query("custom_token_estimate", with_views(FILES_SQL) + "SELECT file_id, len(string_split(content, ' ')) AS tokens FROM files")
def _(t: Tables):
    count_words = extensions.token_estimator(lambda content: len(content.split(" ")))
    return t.files.select("file_id", count_words("content").alias("tokens"))


@query(
    "apply_chunker",
    with_views(FILES_SQL)
    + "SELECT file_id, unnest(range(0, (len(lines) + 9) // 10)) AS chunk_index, unnest(range(0, (len(lines) + 9) // 10)) * 10 + 1 AS start_line FROM files",
)
def _(t: Tables):
    def tens(path, content):
        count = len(content.split("\n"))
        for at in range((count + 9) // 10):
            yield (at, at * 10 + 1, min(count, at * 10 + 10))

    return extensions.apply_chunker(t.files, tens).select("file_id", "chunk_index", "start_line")
