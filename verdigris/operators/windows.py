"""Order-dependent operators over logs: sequences, retention, budgets, limits, streaks, concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import estimate_tokens
from verdigris.operators.running import first_n, latest, running_totals, time_slice

# Retention, budgets and thresholds.
KEEP_DECISIONS = 200
KEEP_REVISIONS = 20
KEEP_MESSAGES = 8
KEEP_CANDIDATES_PER_REVIEW = 8
KEEP_CANDIDATES_PER_OWNER = 20
CONTEXT_CHARS = 6_000
CUT_MARKER = "…较早内容已省略…\n"
USER_LABEL = "用户："
ASSISTANT_LABEL = "助手："
CONTEXT_TOKENS = 40_960
SAFETY_TOKENS = 1_024
MIN_OUTPUT_TOKENS = 512
MAX_OUTPUT_TOKENS = 32_768
FIXED_PROMPT_TOKENS = 2_048
BLOCK_TOKENS = 32
LOGIN_ATTEMPTS = 5
LOGIN_WINDOW_SECONDS = 300
JUDGE_BUDGET = 8
JUDGE_CONFIDENCE = 0.7
ACTIVE_REVIEWS = ("queued", "planning", "analyzing", "reviewing", "validating", "aggregating")
INTERRUPTED_CHUNKS = ("queued", "running", "validating")


def sequence_events(new: DataFrame, stored_max: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Number new events of each review after the highest stored sequence; numbers never restart.

    ``stored_max``: (review_id, last_sequence). A review with very many events is numbered in time slices.
    """
    counted = running_totals(
        new, ["review_id"], [F.col("ts"), F.col("event_id")], time_slice(F.col("ts"), slice_seconds), {"_nth": F.lit(1)}
    )
    joined = counted.join(stored_max, "review_id", "left")
    return joined.select(*new.columns, (F.coalesce("last_sequence", F.lit(0)) + F.col("_nth")).alias("sequence"))


def events_after(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events beyond each reader's cursor. ``cursors``: (review_id, cursor); no cursor means everything."""
    joined = events.join(cursors, "review_id", "left")
    return joined.where(F.col("sequence") > F.coalesce("cursor", F.lit(0))).select(*events.columns)


def keep_last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key; each key is cut before the shuffle."""
    return first_n(df, keys, [F.desc(name) for name in order], n, "_newest").drop("_newest")


def keep_candidates(candidates: DataFrame) -> DataFrame:
    """Fix candidates that fit the cap per review, then the cap per owner; the oldest go first."""
    order = ["created_at", "candidate_id"]
    per_review = keep_last_n(candidates, ["owner_id", "review_id"], order, KEEP_CANDIDATES_PER_REVIEW)
    return keep_last_n(per_review, ["owner_id"], order, KEEP_CANDIDATES_PER_OWNER)


def context_key(finding_id: Column, file_id: Column, start: Column, end: Column, code: Column) -> Column:
    """Key of a follow-up conversation: a finding, a selection of code, or the review as a whole."""
    selection = F.concat_ws(":", F.lit("selection"), file_id, start, end, F.substring(F.sha2(code, 256), 1, 16))
    return (
        F.when(finding_id.isNotNull(), F.concat(F.lit("finding:"), finding_id))
        .when(file_id.isNotNull(), selection)
        .otherwise("review")
    )


def conversation_context(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Recent conversation of each context as one text: the last eight messages, cut from the left."""
    recent = keep_last_n(messages, keys, order, KEEP_MESSAGES)
    line = F.concat(F.when(F.col("role") == "user", USER_LABEL).otherwise(ASSISTANT_LABEL), F.col("content"))
    joined = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda item: item["line"]), "\n")
    cut = F.when(F.length("_text") > CONTEXT_CHARS, F.concat(F.lit(CUT_MARKER), F.right("_text", F.lit(CONTEXT_CHARS)))).otherwise(F.col("_text"))
    return joined.withColumn("_text", text).select(*keys, F.size("_lines").alias("messages"), cut.alias("context"))


def fit_context(
    chunks: DataFrame,
    refs: DataFrame,
    context_tokens: int = CONTEXT_TOKENS,
    safety_tokens: int = SAFETY_TOKENS,
    min_output: int = MIN_OUTPUT_TOKENS,
    max_output: int = MAX_OUTPUT_TOKENS,
    fixed_tokens: int = FIXED_PROMPT_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Decide per chunk what fits its token budget: (decisions, kept references).

    References are kept as the longest prefix by (rank, path, line) that fits. Each costs more than
    ``BLOCK_TOKENS``, so no more than budget / BLOCK_TOKENS of them can ever be kept: chunks are cut to that
    many before the running sum, whatever the number of their references.
    """
    available = context_tokens - safety_tokens
    base = F.lit(fixed_tokens) + estimate_tokens("target_code") + BLOCK_TOKENS
    sized = chunks.withColumn("base_tokens", base)
    most = available // (BLOCK_TOKENS + 1) + 1
    order = [F.col(name) for name in ("rank", "path", "start_line", "end_line", "code")]
    head = first_n(refs, ["chunk_id"], order, most, "position")
    label = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    costed = head.withColumn("cost", estimate_tokens(F.concat(label, F.col("code"))) + BLOCK_TOKENS)
    running = Window.partitionBy("chunk_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = costed.withColumn("_used", F.sum("cost").over(running))
    kept = (
        summed.join(sized.select("chunk_id", "base_tokens"), "chunk_id")
        .where(F.col("base_tokens") + F.col("_used") + min_output <= available)
        .drop("base_tokens", "_used")
    )
    offered = refs.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_offered"))
    taken = kept.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("kept_refs"), F.sum("cost").alias("_cost"))
    joined = sized.join(offered, "chunk_id", "left").join(taken, "chunk_id", "left").fillna(0, ["_offered", "kept_refs", "_cost"])
    overflow = F.col("base_tokens") + min_output > available
    prompt = F.col("base_tokens") + F.col("_cost")
    action = F.when(overflow, "split_target").when(F.col("kept_refs") < F.col("_offered"), "trim_context").otherwise("fits")
    output = F.when(overflow, 0).otherwise(F.least(F.lit(max_output), available - prompt))
    decided = joined.withColumns({"action": action, "prompt_tokens": prompt, "output_tokens": output}).select(
        *chunks.columns, "action", "kept_refs", "prompt_tokens", "output_tokens"
    )
    return decided, kept


def latest_decision(log: DataFrame) -> DataFrame:
    """Current decision per finding; reopened findings have none and are left out."""
    last = latest(log, ["review_id", "finding_id"], ["created_at", "log_id"])
    return last.where("action <> 'reopened'")


def ignored_fingerprints(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """Fingerprints ignored now: the newest decision touching a fingerprint says in or out."""
    adds = F.col("decision").isin("accepted_risk", "dismissed") & (F.col("action") != "reopened")
    touched = log.join(anchors.select("finding_id", "fingerprint"), "finding_id")
    newest = touched.groupBy("review_id", "fingerprint").agg(F.max_by(adds, F.struct("created_at", "log_id")).alias("_in"))
    return newest.where("_in").select("review_id", "fingerprint")


def next_before_text(revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``after_content``: what the next revision of the file started from, else the current text.

    Works on retained revisions (see ``keep_last_n``), so a review has at most ``KEEP_REVISIONS`` of them.
    """
    order = Window.partitionBy("review_id", "file_id").orderBy("created_at", "revision_id")
    following = revisions.withColumn("_next", F.lead("before_content").over(order))
    current = files.select("review_id", "file_id", F.col("content").alias("_current"))
    after = F.when(F.col("undone_at").isNull(), F.coalesce("_next", "_current"))
    return following.join(current, ["review_id", "file_id"], "left").withColumn("after_content", after).drop("_next", "_current")


def undoable_revision(revisions: DataFrame, files: DataFrame) -> DataFrame:
    """The one revision per review that can be undone: the newest active one, if its file is unchanged since."""
    newest = latest(revisions.where(F.col("undone_at").isNull()), ["review_id"], ["created_at", "revision_id"])
    same = files.select("review_id", "file_id", F.col("sha256").alias("after_sha256"))
    return newest.join(same, ["review_id", "file_id", "after_sha256"], "left_semi")


def rate_limit(
    attempts: DataFrame, allowed: int = LOGIN_ATTEMPTS, window_seconds: int = LOGIN_WINDOW_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Add ``recent_failures`` and ``allowed`` as they were when each attempt arrived.

    Counted are failures of the same (user, source) in the trailing window, after the last success; a failure
    exactly as old as the window no longer counts. Only the window matters, so a busy user is cut into time
    slices and every slice also receives the rows of the window before it.
    ``attempts``: attempt_id, username, source, at, succeeded.
    """
    span = max(slice_seconds, window_seconds)
    seconds = F.unix_micros("at")
    own = F.floor(seconds / F.lit(span * 1_000_000))
    tail = F.floor((seconds + window_seconds * 1_000_000) / F.lit(span * 1_000_000))
    copies = F.when(own == tail, F.array(own)).otherwise(F.array(own, tail))
    sliced = (
        attempts.withColumns({"_user": F.lower("username"), "_micros": seconds, "_own": own})
        .withColumn("_slice", F.explode(copies))
    )
    key = ["_user", "source", "_slice"]
    upto = Window.partitionBy(*key).orderBy("_micros").rangeBetween(Window.unboundedPreceding, -1)
    cleared = F.sum(F.col("succeeded").cast("int")).over(upto)
    marked = sliced.withColumn("_run", F.coalesce(cleared, F.lit(0)))
    trailing = Window.partitionBy(*key, "_run").orderBy("_micros").rangeBetween(-(window_seconds * 1_000_000) + 1, -1)
    failures = F.coalesce(F.sum((~F.col("succeeded")).cast("int")).over(trailing), F.lit(0))
    counted = marked.withColumn("recent_failures", failures).where(F.col("_slice") == F.col("_own"))
    return counted.withColumn("allowed", F.col("recent_failures") < allowed).select(*attempts.columns, "recent_failures", "allowed")


def concurrency(leases: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Requests and tokens in flight per endpoint after every start and end of a lease.

    ``leases``: endpoint, lease_id, started_at, ended_at, prompt_tokens, total_tokens. At one instant, ends come first.
    """
    change = lambda at, sign: leases.select(
        "endpoint", "lease_id", F.col(at).alias("at"), F.lit(sign).alias("change"),
        (F.col("prompt_tokens") * sign).alias("_prompt"), (F.col("total_tokens") * sign).alias("_total"),
    )
    steps = change("started_at", 1).unionByName(change("ended_at", -1))
    return running_totals(
        steps,
        ["endpoint"],
        [F.col("at"), F.col("change"), F.col("lease_id")],
        time_slice(F.col("at"), slice_seconds),
        {"requests": F.col("change"), "prompt_in_flight": F.col("_prompt"), "total_in_flight": F.col("_total")},
    ).drop("_prompt", "_total")


def concurrency_profile(leases: DataFrame, max_requests: int, max_prompt: int, max_total: int) -> DataFrame:
    """Peaks per endpoint and whether they were beyond its capacity."""
    peaks = concurrency(leases).groupBy("endpoint").agg(
        F.max("requests").alias("peak_requests"), F.max("prompt_in_flight").alias("peak_prompt"), F.max("total_in_flight").alias("peak_total")
    )
    breached = (F.col("peak_requests") > max_requests) | (F.col("peak_prompt") > max_prompt) | (F.col("peak_total") > max_total)
    return peaks.withColumn("breached", breached)


def judge_budget(findings: DataFrame, order: list[str], budget: int = JUDGE_BUDGET) -> DataFrame:
    """Model findings a judge gets to see: the first few of each review."""
    return first_n(findings.where("source = 'llm'"), ["review_id"], [F.col(name) for name in order], budget, "_nth").drop("_nth")


def apply_judgements(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop findings the judge refused or accepted with too little confidence; unjudged ones pass."""
    refused = verdicts.where(~(F.col("accepted") & (F.col("confidence") >= JUDGE_CONFIDENCE)))
    return findings.join(refused.select("finding_id"), "finding_id", "left_anti")


def single_session(sessions: DataFrame) -> DataFrame:
    """Newest session per user; older ones are signed out."""
    return latest(sessions, ["user_id"], ["created_at", "session_id"])


def round_robin(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows taken in turns over the keys, in the order the keys first appear.

    No key can contribute more than ``n`` rows, so each is cut to ``n`` before the global top-n.
    """
    head = first_n(df, [key], [F.col(name) for name in order], n, "turn")
    arrival = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_arrival"))
    return head.join(arrival, key).orderBy("turn", "_arrival").limit(n).drop("_arrival")


def chunk_module(statements: DataFrame) -> DataFrame:
    """Chunks of a module: each top-level definition alone, runs of other statements together.

    ``statements``: file_id, ord, start_line, end_line, is_definition. A file is bounded by admission.
    """
    order = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.sum(F.col("is_definition").cast("int")).over(order)
    own = F.when(F.col("is_definition"), F.col("ord")).otherwise(-1)
    grouped = (
        statements.withColumn("_seen", seen)
        .groupBy("file_id", "_seen", own.alias("_own"))
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("ord").alias("_first"))
    )
    position = F.row_number().over(Window.partitionBy("file_id").orderBy("_first")) - 1
    return grouped.withColumn("chunk_index", position).select("file_id", "chunk_index", "start_line", "end_line")


def page_reviews(reviews: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a history list, newest first; planned as a top-k."""
    return reviews.orderBy(F.desc("created_at"), F.desc("review_id")).offset(offset).limit(limit)


def page_users(users: DataFrame, text: str | None = None, status: str = "all", page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of users: literal search text, admins first, names without regard to case."""
    if page < 1 or page_size not in (20, 50):
        raise ValueError("page starts at 1 and has 20 or 50 rows")
    if status not in ("all", "active", "disabled"):
        raise ValueError("status is all, active or disabled")
    wanted = matching_users(users, text, status)
    admins_first = F.when(F.col("role") == "admin", 0).otherwise(1)
    return wanted.orderBy(admins_first, F.lower("username"), "user_id").offset((page - 1) * page_size).limit(page_size)


def matching_users(users: DataFrame, text: str | None = None, status: str = "all") -> DataFrame:
    found = users
    if text and text.strip():
        found = found.where(F.contains(F.lower("username"), F.lower(F.lit(text.strip()))))
    if status != "all":
        found = found.where(F.col("is_active") == (status == "active"))
    return found


def recoverable(reviews: DataFrame) -> DataFrame:
    """Reviews a restart has to pick up, oldest first."""
    return reviews.where(~F.col("status").isin("completed", "failed", "cancelled")).orderBy("created_at", "review_id")


def reset_chunks(chunks: DataFrame, reviews: DataFrame, also_failed: bool = False) -> DataFrame:
    """Interrupted chunks of recoverable reviews become pending; a manual resume also retries failed ones."""
    states = INTERRUPTED_CHUNKS + (("failed",) if also_failed else ())
    wanted = reviews.where("status = 'failed'") if also_failed else recoverable(reviews)
    return (
        chunks.join(wanted.select("review_id"), "review_id", "left_semi")
        .withColumn("status", F.when(F.col("status").isin(*states), "pending").otherwise(F.col("status")))
    )
