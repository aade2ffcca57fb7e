"""Views that give the given tables the shape of code-review data.

Each view exists twice: as a DataFrame (``Tables``) and as the SQL text of a common table
expression (``*_SQL``), so that a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import split_lines

FILES_SQL = """files AS (
  SELECT doc_id AS file_id, source AS review_id, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         lang AS language, text AS content,
         CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS lines
  FROM documents)"""

LINES_SQL = """lines AS (
  SELECT file_id, review_id, language, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS text FROM files)"""

SPANS_SQL = """spans AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS finding_id,
         l_orderkey AS review_id, l_orderkey AS file_id, l_linenumber AS start_line,
         l_linenumber + CAST(l_quantity AS INTEGER) AS end_line,
         CAST(1 + l_partkey % 40 AS INTEGER) AS start_column, CAST(11 + l_partkey % 40 AS INTEGER) AS end_column,
         'rule.' || l_returnflag AS rule_id, 'module_' || l_suppkey % 5 AS symbol, 'flag  ' || l_returnflag AS evidence,
         CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'llm' END AS source,
         CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.06 THEN 'high'
              WHEN l_discount >= 0.04 THEN 'medium' WHEN l_discount >= 0.02 THEN 'low' ELSE 'info' END AS severity,
         0.5 + 5 * l_tax AS confidence, l_partkey AS part_id, l_suppkey AS supplier_id,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_shipdate AS created_at
  FROM lineitem)"""

REVIEWS_SQL = """reviews AS (
  SELECT o_orderkey AS review_id, o_custkey AS owner_id, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'reviewing' ELSE 'failed' END AS status,
         o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS amount
  FROM orders)"""

USERS_SQL = """users AS (
  SELECT c_custkey AS user_id, c_name AS username,
         CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role, c_acctbal >= 0 AS is_active,
         c_mktsegment AS segment
  FROM customer)"""

EVENTS_SQL = """log AS (
  SELECT event_id, user_id AS review_id, ts, event_type AS event, value, props AS data FROM events)"""

ATTEMPTS_SQL = """attempts AS (
  SELECT event_id AS attempt_id, user_id AS review_id, user_id % 8 AS endpoint, ts AS started_at, event_type <> 'error' AS ok,
         event_type AS event, CAST(round(value * 100) AS BIGINT) AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
  FROM events)"""

MESSAGES_SQL = """messages AS (
  SELECT conv_id AS context_key, turn, role, text AS content FROM conversations)"""

PATHS_SQL = """paths AS (
  SELECT page_id, regexp_replace(url, '^https?://', '') AS path, regexp_extract(url, '/([a-z]{2})/', 1) AS review_id, url FROM pages)"""

# Findings and model drafts that point into the documents: one per line item, its part folded into the document ids.
TEXT_FINDINGS_SQL = """text_findings AS (
  SELECT s.finding_id, f.review_id, f.file_id, f.path, f.language, s.start_line,
         s.start_line + CAST(s.supplier_id % 3 AS INTEGER) AS end_line, s.start_column, s.end_column, s.rule_id, s.source, s.severity, s.confidence,
         CASE WHEN s.rule_id = 'rule.A' THEN coalesce(f.lines[s.start_line][3:32], 'n/a')
              WHEN s.rule_id = 'rule.N' AND s.supplier_id % 3 = 2 THEN coalesce(right(f.lines[s.start_line + 1], 2) || chr(10) || f.lines[s.start_line + 2], 'n/a')
              WHEN s.rule_id = 'rule.N' THEN coalesce(f.lines[s.start_line] || chr(10) || f.lines[s.start_line + 1], 'n/a')
              ELSE 'not in   the text' END AS evidence,
         f.lines, s.part_id, s.supplier_id
  FROM spans s JOIN files f ON f.file_id = s.part_id % (SELECT count(*) FROM documents))"""


# Tables whose rows are expensive to work on. Where the session sets SPREAD_KEY, they are dealt into that many partitions:
# for test and bench files of a single row group. Unset, tables are read as they lie.
SPREAD = ("documents", "lineitem")
SPREAD_KEY = "spark.verdigris.spread"


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"


class Tables:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        """One given table; a text or fact table in as many partitions as the session asks for, if it does."""
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD_KEY, None) if name in SPREAD else None
        return table.repartition(int(spread)) if spread else table

    @cached_property
    def n_files(self) -> int:
        """Number of documents; their ids run from 0."""
        return max(1, self.spark.read.parquet(f"{self.folder}/documents.parquet").count())

    @property
    def file_of_part(self) -> Column:
        """The document that a line item's part stands for."""
        return F.col("part_id") % self.n_files

    @cached_property
    def files(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("file_id"),
            F.col("source").alias("review_id"),
            F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.col("lang").alias("language"),
            F.col("text").alias("content"),
        )

    @cached_property
    def files_with_lines(self) -> DataFrame:
        return self.files.withColumn("lines", split_lines("content"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.files_with_lines.select(
            "file_id", "review_id", "language", F.posexplode("lines").alias("position", "text")
        ).select("file_id", "review_id", "language", (F.col("position") + 1).alias("line"), "text")

    @cached_property
    def spans(self) -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        level = F.col("l_discount")
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("finding_id"),
            F.col("l_orderkey").alias("review_id"),
            F.col("l_orderkey").alias("file_id"),
            F.col("l_linenumber").alias("start_line"),
            (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end_line"),
            (1 + F.col("l_partkey") % 40).cast("int").alias("start_column"),
            (11 + F.col("l_partkey") % 40).cast("int").alias("end_column"),
            F.concat(F.lit("rule."), "l_returnflag").alias("rule_id"),
            F.concat(F.lit("module_"), (F.col("l_suppkey") % 5).cast("string")).alias("symbol"),
            F.concat(F.lit("flag  "), "l_returnflag").alias("evidence"),
            F.when(F.col("l_linestatus") == "F", "static").otherwise("llm").alias("source"),
            F.when(level >= 0.08, "critical").when(level >= 0.06, "high").when(level >= 0.04, "medium")
            .when(level >= 0.02, "low").otherwise("info").alias("severity"),
            (F.lit(0.5) + F.lit(5) * F.col("l_tax")).alias("confidence"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            cents.alias("amount"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_custkey").alias("owner_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(status == "F", "completed").when(status == "O", "reviewing").otherwise("failed").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.when(F.col("c_custkey") % 100 == 0, "admin").otherwise("user").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.col("c_mktsegment").alias("segment"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("review_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("event"),
            "value",
            F.col("props").alias("data"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("attempt_id"),
            F.col("user_id").alias("review_id"),
            (F.col("user_id") % 8).alias("endpoint"),
            F.col("ts").cast("timestamp").alias("started_at"),
            (F.col("event_type") != "error").alias("ok"),
            F.col("event_type").alias("event"),
            F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
            F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("context_key"), "turn", "role", F.col("text").alias("content")
        )

    @cached_property
    def paths(self) -> DataFrame:
        return self.raw("pages").select(
            "page_id",
            F.regexp_replace("url", "^https?://", "").alias("path"),
            F.regexp_extract("url", "/([a-z]{2})/", 1).alias("review_id"),
            "url",
        )

    @cached_property
    def text_findings(self) -> DataFrame:
        """Span rows that point into the documents, without the text itself."""
        spans = self.spans.drop("review_id", "file_id", "evidence", "end_line")
        files = self.files_with_lines.select("review_id", "file_id", "path", "language", "lines")
        first = F.get(F.col("lines"), F.col("start_line") - 1)
        second = F.get(F.col("lines"), F.col("start_line"))
        third = F.get(F.col("lines"), F.col("start_line") + 1)
        return spans.join(files, self.file_of_part == files.file_id).select(
            "finding_id", "review_id", "file_id", "path", "language", "start_line",
            (F.col("start_line") + (F.col("supplier_id") % 3).cast("int")).alias("end_line"),
            "start_column", "end_column", "rule_id", "source", "severity", "confidence",
            F.when(F.col("rule_id") == "rule.A", F.coalesce(F.substring(first, 3, 30), F.lit("n/a")))
            .when(
                (F.col("rule_id") == "rule.N") & (F.col("supplier_id") % 3 == 2),
                F.coalesce(F.concat(F.right(second, F.lit(2)), F.lit("\n"), third), F.lit("n/a")),
            )
            .when(F.col("rule_id") == "rule.N", F.coalesce(F.concat(first, F.lit("\n"), second), F.lit("n/a")))
            .otherwise("not in   the text").alias("evidence"),
            "part_id", "supplier_id",
        )
