"""Model response logs: decoding, quarantine, salvage, and payload columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.text import col

# Allowed levels in a response.
SEVERITIES = ("critical", "high", "medium", "low", "info")
IMPACTS = ("critical", "high", "medium", "low")
EXPLOITABILITIES = ("high", "medium", "low")
EXPOSURES = ("internet", "authenticated", "internal", "local", "unknown")
MAX_FINDINGS = 50
ANSWER_KEYS = ("answer", "content", "message", "response", "summary")
PREVIEW_FIELDS = ("summary", "title", "evidence", "impact", "suggestion")

ROOT_CAUSE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "claim", "concrete_failing_input", "expected_behavior", "actual_behavior",
            "affected_path", "repair_invariant", "contract_evidence", "reachable_path",
        )
    ]
)
FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("impact", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("impact_level", T.StringType()),
        T.StructField("exploitability", T.StringType()),
        T.StructField("exposure", T.StringType()),
        T.StructField("severity_reason", T.StringType()),
        T.StructField("root_cause_claim", ROOT_CAUSE),
    ]
)
RESPONSE = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("findings", T.ArrayType(FINDING)),
        T.StructField("uncovered", T.ArrayType(T.StringType())),
    ]
)


def strip_fence(content: str | Column) -> Column:
    """Text inside one code fence that wraps the whole answer; other text unchanged."""
    trimmed = F.trim(col(content))
    inner = F.regexp_extract(trimmed, r"(?s)^```[^\n`]*\n(.*)\n```$", 1)
    return F.when(trimmed.rlike(r"(?s)^```[^\n`]*\n.*\n```$"), F.trim(inner)).otherwise(trimmed)


def looks_truncated(content: Column, finish_reason: Column) -> Column:
    body = F.trim(content)
    cut = body.startswith("{") & ~body.endswith("}")
    return F.coalesce(finish_reason == "length", F.lit(False)) | cut


def _filled(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def _finding_is_valid(item: Column) -> Column:
    claim = item["root_cause_claim"]
    claim_ok = claim.isNull() | (
        _filled(claim["claim"]) & _filled(claim["concrete_failing_input"]) & _filled(claim["expected_behavior"])
        & _filled(claim["actual_behavior"]) & _filled(claim["affected_path"]) & _filled(claim["repair_invariant"])
        & (_filled(claim["contract_evidence"]) | _filled(claim["reachable_path"]))
    )
    texts = [_filled(item[name]) for name in ("rule_id", "category", "file", "title", "evidence", "impact", "suggestion")]
    checks = [
        item["severity"].isin(*SEVERITIES),
        item["confidence"].between(0.0, 1.0),
        item["start_line"] >= 1,
        item["end_line"] >= item["start_line"],
        F.coalesce(item["impact_level"].isin(*IMPACTS), F.lit(True)),
        F.coalesce(item["exploitability"].isin(*EXPLOITABILITIES), F.lit(True)),
        F.coalesce(item["exposure"].isin(*EXPOSURES), F.lit(True)),
        F.coalesce(F.length(item["severity_reason"]) <= 500, F.lit(True)),
        claim_ok,
    ]
    verdict = F.lit(True)
    for check in [*texts, *checks]:
        verdict = verdict & F.coalesce(check, F.lit(False))
    return verdict


def parse_model_output(log: DataFrame, content: str = "content", finish_reason: str = "finish_reason") -> DataFrame:
    """Add ``response`` (typed) and ``output_error``; a null error means the response is usable."""
    body = strip_fence(content)
    parsed = F.from_json(F.col("_body"), RESPONSE)
    response = F.col("response")
    syntax_ok = F.try_parse_json(F.col("_body")).isNotNull()
    error = (
        F.when(looks_truncated(F.col("_body"), F.col(finish_reason)), "truncated")
        .when(~syntax_ok | ~F.col("_body").startswith("{"), "not_a_json_object")
        .when(~_filled(response["summary"]) | response["findings"].isNull() | response["uncovered"].isNull(), "missing_field")
        .when((F.size(response["findings"]) > MAX_FINDINGS) | (F.size(response["uncovered"]) > MAX_FINDINGS), "too_many_items")
        .when(~F.forall(response["findings"], _finding_is_valid), "invalid_finding")
    )
    return log.withColumn("_body", body).withColumn("response", parsed).withColumn("output_error", error).drop("_body")


def drafts_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding of the usable responses, with the defaults of the optional fields."""
    rows = parsed.where(F.col("output_error").isNull()).select(*keys, F.posexplode("response.findings").alias("position", "item"))
    defaults = {"impact_level": "medium", "exploitability": "medium", "exposure": "unknown", "severity_reason": ""}
    return rows.select(
        *keys,
        (F.col("position") + 1).alias("position"),
        *[
            F.coalesce(F.col(f"item.{field.name}"), F.lit(defaults[field.name])).alias(field.name)
            if field.name in defaults
            else F.col(f"item.{field.name}").alias(field.name)
            for field in FINDING.fields
        ],
    )


def rejected_output(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("output_error").isNotNull()).drop("response")


def plain_answer(content: str | Column) -> Column:
    """Free-text answer: first non-blank known key of a JSON object, else the text itself."""
    body = strip_fence(content)
    candidates = []
    for key in ANSWER_KEYS:
        value = F.trim(F.get_json_object(body, f"$.{key}"))
        candidates.append(F.when(body.startswith("{") & (value != "") & ~value.rlike(r"^[\[{]"), value))
    return F.coalesce(*candidates, body)


def salvage_truncated_output(bad: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Field values readable in incomplete JSON, each once, in order of appearance.

    A hit is a complete or cut-off string value of one of the known fields.
    """
    hit = r'"(?:%s)"\s*:\s*"(?:[^"\\]|\\.)*' % "|".join(PREVIEW_FIELDS)
    field = lambda raw: F.regexp_extract(raw, r'^"(\w+)"', 1)
    value = lambda raw: F.regexp_replace(raw, r'(?s)^"\w+"\s*:\s*"', "")

    def unescape(text: Column) -> Column:
        marked = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
        for escape, plain in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\/", "/")):
            marked = F.replace(marked, F.lit(escape), F.lit(plain))
        return F.trim(F.replace(F.rtrim(marked), F.lit("\x00"), F.lit("\\")))

    hits = F.regexp_extract_all(F.col(content), F.lit(hit), F.lit(0))
    sections = F.array_distinct(
        F.filter(
            F.transform(hits, lambda raw: F.struct(field(raw).alias("field"), unescape(value(raw)).alias("text"))),
            lambda item: item["text"] != "",
        )
    )
    exploded = bad.select(*keys, F.posexplode(sections).alias("position", "section"))
    return exploded.select(*keys, (F.col("position") + 1).alias("position"), "section.field", "section.text")


def payload_to_columns(df: DataFrame, payload: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Typed columns from a JSON payload; a key column of the row wins over the same field in the payload."""
    parsed = F.from_json(F.col(payload), schema)
    fields = [name for name in schema.fieldNames() if name not in keys]
    others = [name for name in df.columns if name not in {*keys, payload, *fields}]
    return df.withColumn("_payload", parsed).select(*keys, *others, *[F.col(f"_payload.{name}").alias(name) for name in fields])


def columns_to_payload(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Everything but the keys as one JSON column; keys are repeated inside so the payload stands alone."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias(payload))
