"""Row-wise and per-file projections: lines, chunks, prompts, routing, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.arrow import nfkc
from verdigris.functions.text import (
    UNIT_SEPARATOR,
    contains_any,
    estimate_tokens,
    normalize_evidence,
    split_lines,
    squash_whitespace,
)
from verdigris.operators.line_blocks import with_lines

# The rule whose findings carry a file-level anchor.
SYNTAX_RULE = "python.syntax-error"
SYNTAX_ANCHOR = "file-level-python-syntax-error"

# Excerpt and split limits.
EXCERPT_MARGIN = 20
EXCERPT_CHARS = 12_000
MAX_SPLIT_DEPTH = 3

# Words and patterns of the follow-up router.
EDIT_VERBS = "删除|移除|增加|新增|添加|替换|改为|改成|重构|修复"
EXPLANATION_MARKERS = (
    "为什么", "为何", "如何", "怎么", "是否", "有什么影响", "解释", "说明", "什么意思", "能否", "可不可以",
)
TARGET_MARKERS = (
    r"(?iU)第\s*\d+\s*行|代码|函数|方法|类|变量|参数|返回|分支|逻辑|检查|调用|导入|异常|语句|表达式|接口|字段|属性"
    r"|循环|条件|判断|这里|这段|模块|文件|\b(?:def|class|if|return|import)\b"
)
IDENTIFIER_TARGET = (
    r"(?U)^(?:变量|参数)?\s*[A-Za-z_]\w*(?:\s*[，,、]\s*[A-Za-z_]\w*)?(?:\s|$|改|替换|删除|移除)"
)
NEGATED_EDIT = rf"(?:不要|别|无需|不需要|禁止|避免).{{0,20}}(?:{EDIT_VERBS})"
POLITE = "(?:请|请你|帮我|麻烦|直接|现在|立即)?"
DIRECT_EDIT = rf"(?U)^{POLITE}\s*(?:{EDIT_VERBS})(.+)$"
OBJECT_FIRST_EDIT = rf"(?U)^{POLITE}\s*(?:把|将|在)(.+)(?:{EDIT_VERBS})(?:.+)?$"
TARGET_PADDING = " ，,。.!！:：;；"


def anchor_fingerprints(findings: DataFrame, files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Up to three identity hashes per finding: its evidence, the source it spans, and a file-level marker.

    Lines are normalized in their file, once, however many findings span them; findings that lie by file, as a join with files
    leaves them, are not shuffled again. ``also`` keeps columns of the findings.
    """
    first, last = F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.col("start_line"), F.col("end_line"))
    span = F.slice("_all", first, F.greatest(F.lit(0), last - first + 1))
    span_text = F.when(first <= F.col("_n"), F.array_join(span, " "))
    sizes = files.select("file_id", F.size(split_lines("content")).alias("_n"), "path")
    normal_lines = files.select("file_id", F.transform(split_lines("content"), normalize_evidence).alias("_all"))
    anchors = F.array(
        normalize_evidence("evidence"),
        F.coalesce(span_text, F.lit("")),
        F.when(F.col("rule_id") == SYNTAX_RULE, SYNTAX_ANCHOR).otherwise(""),
    )
    prefix = F.concat(
        F.lower(F.coalesce(F.col("path"), F.col("file_id").cast("string"))), F.lit(UNIT_SEPARATOR),
        F.lower("rule_id"), F.lit(UNIT_SEPARATOR),
    )
    hashes = F.transform(
        F.array_distinct(F.filter(anchors, lambda anchor: anchor != "")),
        lambda anchor: F.sha2(F.concat(F.col("_prefix"), anchor), 256),
    )
    spanned = findings.drop("path").join(sizes, "file_id", "left").join(normal_lines, "file_id", "left")
    joined = spanned.withColumn("_prefix", prefix)
    return joined.select("finding_id", "review_id", *also, F.explode(hashes).alias("fingerprint"))


def without_block_comments(content: str | Column) -> Column:
    """Text with comments that open a line blanked out, their newlines kept so that line numbers hold."""
    text = F.col(content) if isinstance(content, str) else content
    comment = r"(?m)^[^\S\n]*(?:/\*(?s:.*?)(?:\*/|\z)[^\S\n]*)+"
    kept = F.split(text, comment, -1)
    newlines = F.transform(
        F.regexp_extract_all(text, F.lit(comment), F.lit(0)),
        lambda hit: F.repeat(F.lit("\n"), F.regexp_count(hit, F.lit("\n"))),
    )
    pieces = F.zip_with(kept, newlines, lambda piece, gap: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(gap, F.lit(""))))
    return F.array_join(pieces, "")


def significant_lines(files: DataFrame) -> DataFrame:
    """Lines that need review: not blank and not a comment. One row per line."""
    is_python = F.col("language") == "python"
    body = F.when(is_python, F.col("content")).otherwise(without_block_comments("content"))
    opener = F.when(is_python, "#").otherwise("//")
    rows = files.select("file_id", opener.alias("_opener"), F.posexplode(split_lines(body)).alias("_position", "_text"))
    text = F.regexp_replace("_text", r"(?U)^\s+", "")
    return rows.where((text != "") & ~text.startswith(F.col("_opener"))).select("file_id", (F.col("_position") + 1).alias("line"))


def file_chunks(files: DataFrame) -> DataFrame:
    """One chunk per whole file, the unit that ``halve_chunks`` works on."""
    return files.select(
        "file_id",
        F.concat(F.col("file_id").cast("string"), F.lit(":0")).alias("chunk_id"),
        F.sha2("content", 256).alias("content_fingerprint"),
        split_lines("content").alias("lines"),
    )


def halve_chunks(chunks: DataFrame, token_budget: int, max_depth: int = MAX_SPLIT_DEPTH) -> DataFrame:
    """Leaves after splitting every chunk over budget at its middle line, at most ``max_depth`` times.

    All rounds happen inside one row, so no shuffle and no repeated scan.
    """

    def node(chunk_id: Column, parent: Column, start: Column, lines: Column, digest: Column, depth: Column) -> Column:
        return F.struct(
            chunk_id.alias("chunk_id"),
            parent.alias("parent_chunk_id"),
            start.alias("start_line"),
            (start + F.size(lines) - 1).alias("end_line"),
            lines.alias("lines"),
            digest.alias("content_fingerprint"),
            depth.alias("split_depth"),
        )

    def half(item: Column, index: int) -> Column:
        middle = F.floor(F.size(item["lines"]) / 2).cast("int")
        lines = (
            F.slice(item["lines"], F.lit(1), middle)
            if index == 1
            else F.slice(item["lines"], middle + 1, F.size(item["lines"]) - middle)
        )
        start = item["start_line"] if index == 1 else item["start_line"] + middle
        code = F.rtrim(F.array_join(lines, "\n"), F.lit("\n"))
        digest = F.sha2(
            F.concat_ws(":", item["content_fingerprint"], start, start + F.size(lines) - 1, code), 256
        )
        return node(
            F.concat(item["chunk_id"], F.lit(f".{index}")), item["chunk_id"], start, lines, digest, item["split_depth"] + 1
        )

    def too_big(item: Column) -> Column:
        return (F.size(item["lines"]) >= 2) & (estimate_tokens(F.array_join(item["lines"], "\n")) > token_budget)

    root = node(
        F.col("chunk_id"), F.lit(None).cast("string"), F.lit(1), F.col("lines"), F.col("content_fingerprint"), F.lit(0)
    )
    nodes = F.array(root)
    for _ in range(max_depth):
        nodes = F.flatten(
            F.transform(nodes, lambda item: F.when(too_big(item), F.array(half(item, 1), half(item, 2))).otherwise(F.array(item)))
        )
    return chunks.select("file_id", F.explode(nodes).alias("leaf")).select("file_id", "leaf.*")


def excerpt(findings: DataFrame, files: DataFrame, margin: int = EXCERPT_MARGIN, max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """Numbered source lines around each finding."""
    first, last = F.greatest(F.lit(1), F.col("start_line") - margin), F.col("end_line") + margin
    numbered = F.array_join(F.transform("_lines", lambda line, at: F.concat_ws(": ", (first + at).cast("string"), line)), "\n")
    cut = F.when(F.length("_text") > max_chars, F.concat(F.substring("_text", 1, max_chars), F.lit("\n…"))).otherwise(F.col("_text"))
    around = with_lines(findings, files, split_lines("content"), first, last)
    return around.withColumn("_text", numbered).select("finding_id", cut.alias("excerpt"))


def build_prompts(chunks: DataFrame, kept_refs: DataFrame, instructions: str, response_schema: str) -> DataFrame:
    """Prompt text per chunk from its code and the references that fit its budget.

    Chunks whose action is ``split_target`` get no prompt: they go back to ``halve_chunks``.
    """
    block = F.concat(
        F.lit("["), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit("]\n"), F.col("code"),
    )
    context = kept_refs.groupBy("chunk_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", block.alias("block")))), lambda item: item["block"]), "\n\n"
        ).alias("context")
    )
    target = F.concat(
        F.lit("TARGET_CODE ["), F.col("target_path"), F.lit(":"), F.col("target_start_line").cast("string"), F.lit("-"),
        F.col("target_end_line").cast("string"), F.lit("]\n"), F.col("target_code"),
        F.lit("\n\nCONTEXT_REFERENCES\n"), F.coalesce(F.col("context"), F.lit("无")),
        F.lit(f"\n\nRESPONSE_SCHEMA\n{response_schema}"),
    )
    return (
        chunks.where(F.col("action") != "split_target")
        .join(context, "chunk_id", "left")
        .select("chunk_id", F.lit(instructions).alias("system"), target.alias("prompt"), F.col("output_tokens").alias("max_output_tokens"))
    )


def route_followup(messages: DataFrame, content: str = "content") -> DataFrame:
    """Add ``route``: ``fix_candidate`` for a clear edit request, ``answer`` for everything else."""
    text = F.col("_prompt")
    questioning = text.contains("?") | text.contains("？") | contains_any(text, EXPLANATION_MARKERS)
    found = F.when(text.rlike(DIRECT_EDIT), F.regexp_extract(text, DIRECT_EDIT, 1)).otherwise(
        F.regexp_extract(text, OBJECT_FIRST_EDIT, 1)
    )
    target = F.trim(found, F.lit(TARGET_PADDING))
    edits = (target != "") & (target.rlike(TARGET_MARKERS) | target.rlike(IDENTIFIER_TARGET))
    route = F.when(questioning | text.rlike(NEGATED_EDIT), "answer").when(edits, "fix_candidate").otherwise("answer")
    return (
        messages.withColumn("_prompt", squash_whitespace(F.lower(nfkc(F.col(content)))))
        .withColumn("route", route)
        .drop("_prompt")
    )


def migrate_decisions(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Old decision names → current ones."""
    value = F.col(decision)
    return df.withColumn(decision, F.when(value == "apply", "fixed").when(value == "keep", "accepted_risk").otherwise(value))


def scope_owner(df: DataFrame, owner: object, column: str = "owner_id") -> DataFrame:
    """Rows of one owner; on a table partitioned by owner this prunes partitions."""
    return df.where(F.col(column) == F.lit(owner))


def redact(revisions: DataFrame, include_diff: bool = False) -> DataFrame:
    """Public view: no owner, no earlier content or ranges, the diff only when asked for."""
    hidden = ["owner_id", "before_content", "before_changed_ranges"] + ([] if include_diff else ["diff"])
    return revisions.drop(*hidden)
