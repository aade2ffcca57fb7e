"""Scoring and gating of model drafts, as one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import contains_any, squash_whitespace

# Points per level, score bounds.
IMPACT_POINTS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
EXPLOITABILITY_POINTS = {"low": 1, "medium": 2, "high": 3}
EXPOSURE_POINTS = {"local": 0, "unknown": 1, "internal": 1, "authenticated": 2, "internet": 3}
MAX_POINTS = 17

# Word lists that decide how a draft is treated.
QUALITY_CATEGORIES = ("code_quality", "quality", "style", "maintainability", "readability")
QUALITY_MARKERS = (
    "未使用", "unused import", "unused variable", "命名", "格式", "注释", "风格", "可读性", "lint", "可维护",
    "重复代码", "magic number",
)
CRITICAL_MARKERS = (
    "远程代码执行", "任意代码执行", "remote code execution", "arbitrary code execution", "认证绕过",
    "身份认证绕过", "auth bypass", "privilege escalation", "权限提升", "任意文件写入", "任意文件删除",
)
HIGH_MARKERS = (
    "命令注入", "command injection", "sql注入", "sql injection", "路径穿越", "path traversal", "服务器端请求伪造",
    "ssrf", "硬编码密钥", "硬编码密码", "hardcoded secret", "存储型 xss", "stored xss", "不安全反序列化",
    "insecure deserialization",
)
HIGH_RISK_MARKERS = (
    "eval(", "exec(", "命令注入", "command injection", "sql注入", "sql injection", "认证绕过", "任意代码执行",
    "远程代码执行", "路径穿越", "不安全反序列化",
)
GENERIC_TITLES = ("存在风险", "代码存在问题", "建议优化", "潜在问题", "未使用安全编码实践")
MIN_TITLE_LENGTH = 6
DETERMINISTIC_RULE_PREFIXES = ("python.", "ruff.", "pyflakes.", "compiler.")
DETERMINISTIC_MARKERS = (
    "名称未定义", "undefined name", "语法错误", "syntax error", "未使用的导入", "unused import", "编译错误",
    "compiler error",
)
SPECULATIVE_MARKERS = (
    "可能", "考虑", "边缘情况", "其他类型", "不完整", " may ", " could ", "consider", "edge case", "other type",
)
BARE_EVAL = r"(?<![\w.])eval\("


def _lookup(table: dict[str, int], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(item) for pair in table.items() for item in pair]), value)


def _claim(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *names))


def score_risk(drafts: DataFrame) -> DataFrame:
    """Replace the model's severity by one computed from its risk factors; add ``risk_score`` and the branch taken."""
    text = squash_whitespace(_claim("rule_id", "category", "title", "evidence", "impact"))
    raw = (
        2 * _lookup(IMPACT_POINTS, F.col("impact_level"))
        + 2 * _lookup(EXPLOITABILITY_POINTS, F.col("exploitability"))
        + _lookup(EXPOSURE_POINTS, F.col("exposure"))
    )
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.round(raw / MAX_POINTS * 100).cast("int")))
    category = F.trim(F.lower("category"))
    quality = contains_any("_text", QUALITY_MARKERS)
    for marker in QUALITY_CATEGORIES:
        quality = quality | (category == marker) | category.startswith(marker + "_") | category.startswith(marker + "/")
    worst = (F.col("impact_level") == "critical") & (F.col("exploitability") == "high")
    critical = contains_any("_text", CRITICAL_MARKERS)
    branch = (
        F.when(quality, "quality")
        .when(critical & worst, "critical_boundary")
        .when(critical, "boundary")
        .when(contains_any("_text", HIGH_MARKERS), "attack_pattern")
        .otherwise("factors")
    )
    points, taken = F.col("_score"), F.col("severity_basis")
    by_factors = (
        F.when(points >= 85, "critical").when(points >= 60, "high").when(points >= 40, "medium")
        .when(points >= 20, "low").otherwise("info")
    )
    severity = (
        F.when(taken == "quality", "info")
        .when(taken == "critical_boundary", "critical")
        .when(taken == "boundary", F.when(points >= 70, "critical").otherwise("high"))
        .when(
            taken == "attack_pattern",
            F.when(points >= 85, "critical").when(points >= 45, "high").otherwise("medium"),
        )
        .otherwise(by_factors)
    )
    attack_floor = (
        F.when(F.col("severity") == "critical", 85).when(F.col("severity") == "high", 60).otherwise(45)
    )
    final = (
        F.when(taken == "quality", F.least(points, F.lit(20)))
        .when(taken == "critical_boundary", F.greatest(points, F.lit(85)))
        .when(taken == "attack_pattern", F.greatest(points, attack_floor))
        .otherwise(points)
    )
    return (
        drafts.withColumns({"_text": text, "_score": score})
        .withColumn("severity_basis", branch)
        .withColumn("severity", severity)
        .withColumn("risk_score", final)
        .drop("_text", "_score")
    )


def cap_severity(drafts: DataFrame) -> DataFrame:
    """critical and high need a high-risk marker in the claim, else they become medium."""
    unbacked = F.col("severity").isin("critical", "high") & ~contains_any(
        _claim("rule_id", "category", "title", "evidence"), HIGH_RISK_MARKERS
    )
    return drafts.withColumn("severity", F.when(unbacked, "medium").otherwise(F.col("severity")))


def gate_drafts(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``gate_reason``: why a draft is dropped before its evidence is looked at; null means it passes.

    ``files`` gives (review_id, path, line_count), unique per review and path.
    """
    claim = _claim("rule_id", "category", "title", "evidence")
    title = F.trim("title")
    rule = F.lower("rule_id")
    deterministic = contains_any(claim, DETERMINISTIC_MARKERS)
    for prefix in DETERMINISTIC_RULE_PREFIXES:
        deterministic = deterministic | rule.startswith(prefix)
    in_range = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (
        F.col("end_line") <= F.greatest(F.lit(1), F.col("line_count"))
    )
    reason = (
        F.when(F.col("line_count").isNull(), "unknown_file")
        .when(~in_range, "range_outside_file")
        .when(title.isin(*GENERIC_TITLES), "generic_title")
        .when(F.length(title) < MIN_TITLE_LENGTH, "short_title")
        .when(F.lower("evidence").contains("literal_eval(") & claim.rlike(BARE_EVAL), "literal_eval_confusion")
        .when(deterministic, "deterministic_claim")
    )
    known = files.select("review_id", F.col("path").alias("file"), "line_count")
    return drafts.join(known, ["review_id", "file"], "left").withColumn("gate_reason", reason).drop("line_count")


def gate_drafts_semantic(drafts: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Add ``verdict_code``: verified, or the first reason to suppress.

    Expects ``affected_path`` and ``has_root_cause`` from the root-cause claim, ``naming_code`` from the
    parameter-naming check (null when the draft is not about naming) and ``has_bool_fallback`` of the
    enclosing function. The confidence step is off unless asked for: the root-cause step already decides.
    """
    text = F.lower(F.concat_ws(" ", "title", "impact", "suggestion", "evidence"))
    speculative = contains_any(text, SPECULATIVE_MARKERS)
    code = (
        F.when(F.col("naming_code").isNotNull(), F.col("naming_code"))
        .when(F.col("has_bool_fallback") & F.col("evidence").contains("isinstance") & speculative, "speculative_finding")
        .when(~F.col("has_root_cause") & speculative, "speculative_finding")
        .when(~F.col("has_root_cause"), "root_cause_unverified")
        .when(~F.col("affected_path").eqNullSafe(F.col("file")), "root_cause_unverified")
    )
    if min_confidence is not None:
        code = code.when(F.col("confidence") < min_confidence, "finding_not_actionable")
    return drafts.withColumn("verdict_code", code.otherwise("verified"))


def source_kind(findings: DataFrame) -> DataFrame:
    """How far a finding is backed."""
    kind = (
        F.when(F.col("source") == "static", "deterministic_fact")
        .when(F.col("range_valid") & F.col("evidence_matched"), "verified_hypothesis")
        .otherwise("model_hypothesis")
    )
    return findings.withColumn("source_kind", kind)
