"""Streaming queries. Each reads the event table as a stream, runs until it is drained, and returns what was written."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.bindings import ATTEMPTS_SQL, EVENTS_SQL, Tables, with_views
from verdigris.plans.registry import query
from verdigris.session import scratch_path
from verdigris.streaming import runs, stateful, windowed


def event_stream(t: Tables) -> DataFrame:
    # A pattern, because a stream takes a folder or a pattern but not the path of one file.
    raw = runs.read_stream(t.spark, f"{t.folder}/event[s].parquet", t.raw("events").schema)
    return raw.select(
        F.col("event_id").alias("sequence"), F.col("user_id").alias("review_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("event"), "value", "props",
    )


def attempt_stream(t: Tables) -> DataFrame:
    return event_stream(t).select(
        "sequence", "at", (F.col("review_id") % 8).alias("endpoint"), F.col("ts").alias("started_at"), (F.col("event") != "error").alias("ok"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"), "event",
    )


@query("tail_events", with_views(EVENTS_SQL) + "SELECT event_id AS sequence, review_id, event FROM log WHERE review_id % 3 = 0 OR event_id > review_id * 50")
def _(t: Tables):
    cursors = t.events.where("review_id % 3 <> 0").select("review_id", (F.col("review_id") * 50).alias("cursor")).distinct()
    tailed = windowed.tail_events(event_stream(t).select("sequence", "review_id", "event"), cursors)
    return runs.append_all(tailed, "tail")


STATUS_SQL = "CASE event WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'superseded' END"


@query(
    "live_progress",
    with_views(EVENTS_SQL, f"c AS (SELECT review_id, {STATUS_SQL} AS status FROM log)")
    + """
    SELECT review_id, count(*) FILTER (status <> 'superseded') AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS queued,
      coalesce(count(*) FILTER (status = 'completed') * 100.0 / nullif(count(*) FILTER (status <> 'superseded'), 0), 100.0) AS percent FROM c GROUP BY review_id""",
)
def _(t: Tables):
    chunks = event_stream(t).select("review_id", F.expr(STATUS_SQL).alias("status"))
    return runs.upsert_all(windowed.live_progress(chunks), "progress", ["review_id"], ["total"], output_mode="update")


@query(
    "stream_upsert",
    with_views(EVENTS_SQL)
    + "SELECT review_id, event, value FROM (SELECT *, row_number() OVER (PARTITION BY review_id, event ORDER BY ts DESC, event_id DESC) AS n FROM log) WHERE n = 1",
)
def _(t: Tables):
    rows = event_stream(t).select("review_id", "event", "value", "ts", "sequence")
    return runs.upsert_all(rows, "upsert", ["review_id", "event"], ["ts", "sequence"]).select("review_id", "event", "value")


@query("stream_dedupe", with_views(EVENTS_SQL) + "SELECT DISTINCT review_id, event FROM log")
def _(t: Tables):
    unique = windowed.stream_dedupe(event_stream(t).select("review_id", "event", "ts"), ["review_id", "event"], lateness="365 days")
    return runs.append_all(unique, "dedupe").select("review_id", "event")


RATES_SQL = """SELECT endpoint, CAST(window_start AS VARCHAR) AS window_start, count(*) AS attempts, count(*) FILTER (NOT ok) / count(*) AS error_rate, sum(latency_ms) / count(*) AS mean_latency_ms
    FROM ({}) GROUP BY endpoint, window_start HAVING window_start + INTERVAL {} MINUTE <= (SELECT date_trunc('millisecond', max(started_at)) - INTERVAL 10 MINUTE FROM attempts)"""


@query(
    "windowed_rates",
    with_views(ATTEMPTS_SQL) + RATES_SQL.format("SELECT *, date_trunc('minute', started_at) AS window_start FROM attempts", 1),
)
def _(t: Tables):
    rates = runs.append_all(windowed.windowed_rates(attempt_stream(t)), "rates")
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "sliding_rates",
    with_views(ATTEMPTS_SQL)
    + RATES_SQL.format("SELECT *, time_bucket(INTERVAL 30 MINUTE, started_at) - to_minutes(unnest([0, 30])) AS window_start FROM attempts", 60),
)
def _(t: Tables):
    rates = runs.append_all(windowed.windowed_rates(attempt_stream(t), "60 minutes", "30 minutes"), "sliding")
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "session_activity",
    with_views(EVENTS_SQL)
    + """
    , cut AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY review_id ORDER BY ts)),
    grouped AS (SELECT review_id, min(ts) AS s, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS events FROM (SELECT *, sum(opens) OVER (PARTITION BY review_id ORDER BY ts) AS g FROM cut) GROUP BY review_id, g)
    SELECT review_id, epoch_us(s) AS started, epoch_us(e) AS ended, events FROM grouped WHERE e <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM log)""",
)
def _(t: Tables):
    sessions = runs.append_all(windowed.session_activity(event_stream(t), "review_id", "ts", "6 hours"), "sessions")
    return sessions.select("review_id", F.unix_micros("session_start").alias("started"), F.unix_micros("session_end").alias("ended"), "events")


MOVE_SQL = "CASE event WHEN 'signup' THEN 'planning' WHEN 'view' THEN 'reviewing' WHEN 'click' THEN 'aggregating' WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'completed' ELSE 'queued' END ELSE CASE WHEN value > 200 THEN 'cancelled' WHEN value > 20 THEN 'failed' ELSE 'queued' END END"
ALLOWED_SQL = """ 'queued>planning queued>failed queued>cancelled planning>reviewing planning>completed planning>failed planning>cancelled reviewing>aggregating reviewing>failed reviewing>cancelled aggregating>completed aggregating>failed aggregating>cancelled completed>queued failed>queued' """


MACHINE_SQL = (
    with_views(
        EVENTS_SQL,
        f"moves AS (SELECT event_id AS sequence, review_id, {MOVE_SQL} AS want, row_number() OVER (PARTITION BY review_id ORDER BY ts, event_id) AS n FROM log)",
        f"""walked AS (
          SELECT review_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sequence, '' AS from_status, '' AS want, false AS accepted, 'queued' AS status FROM (SELECT DISTINCT review_id FROM log)
          UNION ALL
          SELECT m.review_id, m.n, m.sequence, w.status, m.want, contains({ALLOWED_SQL}, w.status || '>' || m.want), CASE WHEN contains({ALLOWED_SQL}, w.status || '>' || m.want) THEN m.want ELSE w.status END
          FROM walked w JOIN moves m ON m.review_id = w.review_id AND m.n = w.n + 1)""",
    )
    + "SELECT review_id, sequence, from_status, want AS to_status, accepted FROM walked WHERE n > 0"
)


@query("review_state_machine", MACHINE_SQL)
def _(t: Tables):
    moves = event_stream(t).select("review_id", "sequence", "at", F.expr(MOVE_SQL).alias("to_status"))
    return runs.append_all(stateful.review_state_machine(moves), "machine")


LIFECYCLE_SQL = """SELECT * FROM (VALUES ('found', 'none', 'active'), ('found', 'fixed_pending_revalidation', 'reopened'), ('found', 'fixed_verified', 'reopened'),
    ('candidate', 'active', 'candidate_ready'), ('candidate', 'reopened', 'candidate_ready'), ('candidate', 'candidate_ready', 'candidate_ready'),
    ('fix', 'active', 'fixed_pending_revalidation'), ('fix', 'reopened', 'fixed_pending_revalidation'), ('fix', 'candidate_ready', 'fixed_pending_revalidation'),
    ('not_found', 'fixed_pending_revalidation', 'fixed_verified'),
    ('accept', 'active', 'accepted_risk'), ('accept', 'reopened', 'accepted_risk'), ('accept', 'candidate_ready', 'accepted_risk'), ('accept', 'deferred', 'accepted_risk'),
    ('defer', 'active', 'deferred'), ('defer', 'reopened', 'deferred'), ('defer', 'candidate_ready', 'deferred'),
    ('dismiss', 'active', 'dismissed'), ('dismiss', 'reopened', 'dismissed'), ('dismiss', 'candidate_ready', 'dismissed'), ('dismiss', 'deferred', 'dismissed'),
    ('reopen', 'fixed_pending_revalidation', 'reopened'), ('reopen', 'fixed_verified', 'reopened'), ('reopen', 'accepted_risk', 'reopened'), ('reopen', 'deferred', 'reopened'),
    ('reopen', 'dismissed', 'reopened')) AS v(action, was, becomes)"""


@query(
    "finding_lifecycle",
    with_views(
        EVENTS_SQL,
        f"moves AS ({LIFECYCLE_SQL})",
        """actions AS (
          SELECT review_id, event_id % 5 AS finding_id, event_id AS sequence,
            ['found', 'candidate', 'fix', 'not_found', 'accept', 'defer', 'dismiss', 'reopen'][CAST(floor(value * 100) AS BIGINT) % 8 + 1] AS action,
            row_number() OVER (PARTITION BY review_id, event_id % 5 ORDER BY ts, event_id) AS n FROM log)""",
        """lived AS (
          SELECT review_id, finding_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sequence, 'none' AS state, false AS moved FROM (SELECT DISTINCT review_id, finding_id FROM actions)
          UNION ALL
          SELECT a.review_id, a.finding_id, a.n, a.sequence, coalesce(m.becomes, l.state), m.becomes IS NOT NULL
          FROM lived l JOIN actions a ON a.review_id = l.review_id AND a.finding_id = l.finding_id AND a.n = l.n + 1 LEFT JOIN moves m ON m.action = a.action AND m.was = l.state)""",
    )
    + "SELECT review_id, finding_id, sequence, state FROM lived WHERE moved",
)
def _(t: Tables):
    names = F.array(*[F.lit(item) for item in ("found", "candidate", "fix", "not_found", "accept", "defer", "dismiss", "reopen")])
    actions = event_stream(t).select(
        "review_id", (F.col("sequence") % 5).alias("finding_id"), "sequence", "at", F.get(names, (F.floor(F.col("value") * 100) % 8).cast("int")).alias("action")
    )
    return runs.append_all(stateful.finding_lifecycle(actions), "lifecycle")


@query(
    "drop_stale_attempts",
    with_views(
        EVENTS_SQL,
        """kinds AS (SELECT event_id, review_id, ts, CASE event WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' ELSE 'result' END AS kind, CAST(json_extract_string(data, '$.k') AS BIGINT) % 3 AS attempt FROM log),
        marked AS (
          SELECT *, max(CASE WHEN kind = 'start' THEN struct_pack(t := ts, i := event_id, a := attempt) END) OVER w AS started,
            max(CASE WHEN kind = 'stop' THEN struct_pack(t := ts, i := event_id, a := attempt) END) OVER w AS stopped FROM kinds
          WINDOW w AS (PARTITION BY review_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        results AS (SELECT *, coalesce(started IS NOT NULL AND (stopped IS NULL OR stopped < started) AND started.a = attempt, false) AS good FROM marked WHERE kind = 'result')""",
    )
    + """
    SELECT review_id, event_id AS sequence, attempt, good AND row_number() OVER (PARTITION BY review_id, started, good ORDER BY ts, event_id) = 1 AS applied FROM results""",
)
def _(t: Tables):
    kinds = F.when(F.col("event") == "signup", "start").when(F.col("event") == "error", "stop").otherwise("result")
    attempt = F.get_json_object("props", "$.k").cast("long") % 3
    return runs.append_all(stateful.drop_stale_attempts(event_stream(t).select("review_id", "sequence", "at", kinds.alias("kind"), attempt.alias("attempt"))), "stale")


def clock_stream(t: Tables) -> DataFrame:
    kind = F.when(F.col("event").isin("signup", "view"), "start").otherwise("finish")
    return event_stream(t).withWatermark("ts", "10 minutes").select("review_id", "sequence", "at", "ts", kind.alias("kind"))


EXPIRED_SQL = """timed AS (SELECT *, lead(ts) OVER (PARTITION BY review_id ORDER BY ts, event_id) AS following, ts + INTERVAL {0} SECOND AS deadline FROM log)
    SELECT review_id, event_id AS sequence, epoch_us(deadline) AS expired_at FROM timed
    WHERE {1} (following > deadline OR (following IS NULL AND deadline < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM log)))"""


@query("deadline_monitor", with_views(EVENTS_SQL).rstrip() + ",\n" + EXPIRED_SQL.format(7200, "event IN ('signup', 'view') AND"))
def _(t: Tables):
    return runs.append_all(stateful.deadline_monitor(clock_stream(t), 7200), "deadlines")


@query("expire_by_ttl", with_views(EVENTS_SQL).rstrip() + ",\n" + EXPIRED_SQL.format(43200, ""))
def _(t: Tables):
    return runs.append_all(stateful.expire_by_ttl(clock_stream(t), 43200), "ttl")


@query(
    "stream_rate_limit",
    with_views(EVENTS_SQL)
    + """
    , tries AS (SELECT event_id AS attempt_id, 'user' || review_id % 40 AS username, event_id % 2 AS source, ts AS moment, event = 'purchase' AS succeeded FROM log),
    cleared AS (SELECT *, max(CASE WHEN succeeded THEN moment END) OVER (PARTITION BY username, source ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM tries)
    SELECT c.username, c.source, c.attempt_id AS sequence, count(f.attempt_id) AS recent_failures, count(f.attempt_id) < 3 AS allowed
    FROM cleared c LEFT JOIN tries f ON f.username = c.username AND f.source = c.source AND NOT f.succeeded AND f.moment < c.moment AND f.moment > c.moment - INTERVAL 90000 SECOND AND f.moment >= coalesce(c.since, f.moment)
    GROUP BY ALL""",
)
def _(t: Tables):
    tries = event_stream(t).select(
        F.concat(F.when(F.col("sequence") % 3 == 0, "USER").otherwise("user"), (F.col("review_id") % 40).cast("string")).alias("username"),
        (F.col("sequence") % 2).alias("source"), "sequence", "at",
        (F.col("event") == "purchase").alias("succeeded"),
    )
    return runs.append_all(stateful.stream_rate_limit(tries, 3, 90000), "limits")


CIRCUIT_SQL = (
    with_views(
        ATTEMPTS_SQL,
        """outcomes AS (
          SELECT endpoint, attempt_id, started_at AS moment, CASE event WHEN 'view' THEN 'neutral' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS outcome,
            row_number() OVER (PARTITION BY endpoint ORDER BY started_at, attempt_id) AS rn FROM attempts)""",
        """circuit AS (
          SELECT endpoint, attempt_id, rn, CASE outcome WHEN 'failed' THEN 1 ELSE 0 END AS streak, CAST(NULL AS TIMESTAMP) AS opened FROM outcomes WHERE rn = 1
          UNION ALL
          SELECT o.endpoint, o.attempt_id, o.rn, CASE outcome WHEN 'ok' THEN 0 WHEN 'failed' THEN c.before + 1 ELSE c.before END,
            CASE outcome WHEN 'ok' THEN NULL WHEN 'failed' THEN CASE WHEN c.before + 1 >= 3 THEN o.moment END ELSE c.was END
          FROM outcomes o JOIN (SELECT endpoint, rn, streak, opened FROM circuit) p ON o.endpoint = p.endpoint AND o.rn = p.rn + 1,
          LATERAL (SELECT CASE WHEN p.opened IS NOT NULL AND o.moment - p.opened > INTERVAL 2400 SECOND THEN 0 ELSE p.streak END AS before,
                          CASE WHEN p.opened IS NOT NULL AND o.moment - p.opened > INTERVAL 2400 SECOND THEN NULL ELSE p.opened END AS was) c)""",
    )
    + "SELECT endpoint, attempt_id AS sequence, streak, opened IS NOT NULL AS circuit_open FROM circuit"
)


@query("stream_circuit", CIRCUIT_SQL)
def _(t: Tables):
    outcome = F.when(F.col("event") == "view", "neutral").when(F.col("event") == "purchase", "ok").otherwise("failed")
    return runs.append_all(stateful.stream_circuit(attempt_stream(t).select("endpoint", "sequence", "at", outcome.alias("outcome")), cooldown_seconds=2400), "circuit")


def dealt_stream(t: Tables, parts: int = 4) -> DataFrame:
    """The events a file per batch, in files that are out of order by up to two days and shuffled within."""
    shifted = F.col("at") + F.pmod(F.xxhash64("sequence"), F.lit(2 * 86_400 * 1_000_000))
    raw = t.raw("events")
    rows = raw.select(
        F.col("event_id").alias("sequence"), F.col("user_id").alias("review_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("event"), "value",
    )
    cuts = rows.select(shifted.alias("s")).agg(F.expr(f"percentile_approx(s, array({', '.join(str(at / parts) for at in range(1, parts))}))")).first()[0]
    part = F.aggregate(F.lit(list(cuts or [])).cast("array<long>"), F.lit(0), lambda n, cut: n + F.when(shifted > cut, 1).otherwise(0))
    folder = scratch_path(t.spark, "dealt")
    for at in range(parts):
        rows.where(part == at).coalesce(1).write.mode("append").parquet(folder)
    return runs.read_stream(t.spark, folder, rows.schema, 1)


#: Slots of a minute that end by the time that the watermark has reached are out; the last three days still wait.
RELEASED_SQL = """SELECT *, false AS late FROM ({}) WHERE sequence IN (
      SELECT event_id FROM events WHERE epoch_us(ts) // 60000000 < (SELECT (epoch_us(max(ts)) // 1000 - 3 * 86400000) // 60000 FROM events))"""


@query("ordered_state_machine", RELEASED_SQL.format(MACHINE_SQL))
def _(t: Tables):
    moves = dealt_stream(t).select("review_id", "sequence", "at", "ts", F.expr(MOVE_SQL).alias("to_status"))
    return runs.append_all(stateful.review_state_machine(moves, lateness="3 days"), "machine")


@query("ordered_circuit", RELEASED_SQL.format(CIRCUIT_SQL))
def _(t: Tables):
    outcome = F.when(F.col("event") == "view", "neutral").when(F.col("event") == "purchase", "ok").otherwise("failed")
    attempts = dealt_stream(t).select((F.col("review_id") % 8).alias("endpoint"), "sequence", "at", "ts", outcome.alias("outcome"))
    return runs.append_all(stateful.stream_circuit(attempts, cooldown_seconds=2400, lateness="3 days"), "circuit")
