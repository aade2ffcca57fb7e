import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.operators import circuit, projections, running, windows

START = datetime(2024, 1, 1)


def test_running_totals_equal_a_plain_window_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 5), at, rng.randint(0, 9)) for at in range(2000)]
    df = spark.createDataFrame(rows, "key int, at int, amount int")
    sliced = running.running_totals(df, ["key"], [F.col("at")], F.floor(F.col("at") / 50), {"total": F.col("amount")})
    plain = df.withColumn("total", F.sum("amount").over(Window.partitionBy("key").orderBy("at")))
    assert sliced.exceptAll(plain).count() == 0 and plain.exceptAll(sliced).count() == 0


def test_sequence_goes_on_after_a_reset(spark):
    events = spark.createDataFrame([(1, 5, START), (1, 6, START + timedelta(hours=3)), (2, 7, START)], "review_id int, event_id int, ts timestamp")
    stored = spark.createDataFrame([(1, 2)], "review_id int, last_sequence int")
    numbered = windows.sequence_events(events, stored)
    assert sorted((row.event_id, row.sequence) for row in numbered.collect()) == [(5, 3), (6, 4), (7, 1)]
    cursor = spark.createDataFrame([(1, 3)], "review_id int, cursor int")
    assert sorted(row.event_id for row in windows.events_after(numbered, cursor).collect()) == [6, 7]


def test_rate_limit_window_edges(spark):
    moments = [0, 1, 2, 3, 4, 5, 300, 301.5, 302, 303, 304]
    rows = [(at, "Bob" if at % 2 else "bob", "ip", START + timedelta(seconds=second), second == 302) for at, second in enumerate(moments)]
    df = spark.createDataFrame(rows, "attempt_id int, username string, source string, at timestamp, succeeded boolean")
    got = {row.attempt_id: (row.recent_failures, row.allowed) for row in windows.rate_limit(df).collect()}
    assert got[5] == (5, False)
    assert got[6] == (5, False)  # at 300 s the failure at 0 s no longer counts, the one at 5 s does
    assert got[7][0] == 5 and got[8][0] == 5 and got[9] == (0, True) and got[10] == (1, True)


def circuit_rule(rows, threshold=3, cooldown=30):
    streak, opened, out = 0, None, {}
    for attempt, second, outcome in rows:
        if opened is not None and second - opened > cooldown:
            streak, opened = 0, None
        if outcome == "ok":
            streak, opened = 0, None
        elif outcome == "failed":
            streak += 1
            opened = second if streak >= threshold else None
        out[attempt] = (streak, opened is not None)
    return out


@pytest.mark.parametrize("slice_seconds", [60, 3600])
def test_failure_streaks_over_slices(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    second, rows = 0, []
    for at in range(600):
        second += rng.choice([1, 5, 20, 40])
        rows.append((at, second, rng.choice(["failed"] * 5 + ["ok", "neutral"])))
    df = spark.createDataFrame([(1, at, START + timedelta(seconds=s), o) for at, s, o in rows], "endpoint int, attempt_id long, started_at timestamp, outcome string")
    got = {row.attempt_id: (row.streak, row.circuit_open) for row in circuit.failure_streaks(df, slice_seconds=slice_seconds).collect()}
    assert got == circuit_rule(rows)


def test_context_budget(spark):
    chunks = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 9000)], "chunk_id string, target_code string")
    refs = spark.createDataFrame([("a", at % 3, f"p{at}", at, at + 1, "y" * 200) for at in range(40)], "chunk_id string, rank int, path string, start_line int, end_line int, code string")
    decided, kept = windows.fit_context(chunks, refs, context_tokens=7000)
    got = {row.chunk_id: row for row in decided.collect()}
    assert got["a"].action == "trim_context" and got["b"].action == "split_target" and got["b"].output_tokens == 0
    assert got["a"].prompt_tokens + got["a"].output_tokens <= 7000 - 1024 and got["a"].output_tokens >= 512
    assert kept.agg(F.max("position")).first()[0] == got["a"].kept_refs


def test_conversations_do_not_mix(spark):
    rows = [(key, at, "user" if at % 2 == 0 else "assistant", f"{key}-{at}") for key in ("finding:1", "review") for at in range(12)]
    got = windows.conversation_context(spark.createDataFrame(rows, "context_key string, turn int, role string, content string"), ["context_key"], ["turn"])
    for row in got.collect():
        assert row.messages == 8 and row.context.count(row.context_key) == 8 and f"{row.context_key}-3" not in row.context


EDITS = [
    "删除变量 x", "请把 total 改为 count", "修复这段逻辑", "帮我重构这个函数", "请添加参数检查", "移除未使用的导入",
    "将返回值替换为 None", "在循环里增加判断", "直接删除第 12 行", "新增异常处理代码", "替换 foo, bar",
]
ANSWERS = ["为什么要删除变量?", "不要删除这个函数", "解释这段代码", "如何修复这里", "这个函数是否正确", "hello", "", "删除", "说明修改变量的影响"]


def test_follow_up_routing(spark):
    df = spark.createDataFrame([(content,) for content in EDITS + ANSWERS], "content string")
    got = {row.content: row.route for row in projections.route_followup(df).collect()}
    assert [content for content in EDITS if got[content] != "fix_candidate"] == []
    assert [content for content in ANSWERS if got[content] != "answer"] == []


def test_round_robin_takes_turns(spark):
    rows = [("a", at) for at in range(5)] + [("b", 10), ("c", 11)]
    got = windows.round_robin(spark.createDataFrame(rows, "key string, at int"), "key", ["at"], 5)
    assert [(row.key, row.at) for row in got.collect()] == [("a", 0), ("b", 10), ("c", 11), ("a", 1), ("a", 2)]


def test_user_page(spark):
    users = spark.createDataFrame([(1, "root", "admin", True), (2, "alina", "user", True), (3, "Alice", "user", True), (4, "bob", "user", False)], "user_id int, username string, role string, is_active boolean")
    assert [row.username for row in windows.page_users(users, "ali", "active").collect()] == ["Alice", "alina"]
    assert [row.username for row in windows.page_users(users).collect()][0] == "root"
    assert windows.page_users(users, "a%", "all").count() == 0
    with pytest.raises(ValueError):
        windows.page_users(users, page_size=10)


def test_halving_keeps_every_line(spark):
    content = "\n".join(f"line {at}" for at in range(37))
    files = spark.createDataFrame([(1, content)], "file_id int, content string")
    leaves = projections.halve_chunks(projections.file_chunks(files), token_budget=20).orderBy("start_line").collect()
    assert "\n".join("\n".join(leaf.lines) for leaf in leaves) == content
    assert max(leaf.split_depth for leaf in leaves) == 3 and len(leaves) == 8
