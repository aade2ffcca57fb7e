"""Queries over vectors and over pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import contain, kd_search, ngram_lm, simhash, spans
from verdigris.llm.common import fraction_of, table
from verdigris.llm.registry import query
from verdigris.session import settle

_SQL10 = """
WITH good AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_kd_search", _SQL10)
def op10_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL6 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(5, len(w)) AS k FROM (
    SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
n AS (SELECT item_id, count(*) AS shingles FROM si GROUP BY item_id),
sd AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (
    SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM sd JOIN si USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment FROM m JOIN n USING (item_id)
WHERE shared >= 0.8 * shingles - 1e-9
"""


@query("op6_decontaminate", _SQL6)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contain.with_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.shared", "m.shingles", "m.containment")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = settle(simhash.with_fingerprint(docs, shingle=3).select("doc_id", "fingerprint"), "document-fingerprints")
    return simhash.group_of(printed).select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


_SQL1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 49], ' ')) AS m FROM p),
f AS (SELECT m, min(doc_id) AS low FROM s GROUP BY m HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM s JOIN f USING (m) WHERE doc_id > low),
x AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS pos FROM d),
k AS (
  SELECT x.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (r.pos IS NOT NULL) AS n_removed,
    coalesce(string_agg(w[x.pos], ' ' ORDER BY x.pos) FILTER (r.pos IS NULL AND x.pos > 0), '') AS kept
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.pos = r.pos GROUP BY x.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""


@query("op1_spans", _SQL1)
def op1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_ngram_lm")
def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Every training pair is stored, so that the probabilities after each context sum to one.
    return ngram_lm.score(docs, fraction_of("doc_id") == 1, least_count=1).withColumnRenamed("id", "doc_id")
