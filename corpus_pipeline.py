"""A training-data pipeline over ``documents``: quality, near copies, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bpe, contain, quality, secret_scan, simhash
from verdigris.llm.common import fresh, sift, table
from verdigris.llm.queries_text import rank_file
from verdigris.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below 0.3. It learns from the labelled ones; without labels all stay.

    Null texts are scored as empty ones; equal rows share their fate; an empty table stays empty.
    """
    labels = settle(quality.labels_of(table(spark, sf_dir, "labels")), "quality-labels")
    # Features first: the labels then meet a few numbers per document instead of its text.
    known = quality.with_features(sift(docs.select("doc_id", "text"), labels, ["doc_id"])).select("doc_id", "features")
    forest = quality.fit(settle(known, "quality-features").join(labels, "doc_id"), "quality", F.col("doc_id"))
    score = fresh(docs, "quality_score")
    return quality.with_score(docs, forest, score=score).where(F.col(score) >= 0.3).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: five words, similarity 0.8 or more."""
    return simhash.without_near_duplicates(docs, least=0.8, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 0.8 or more of a benchmark item's shingles of five words."""
    matches = fresh(docs, "benchmark_matches")
    found = contain.with_matches(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, shingle=5, matches=matches)
    return found.where(F.size(matches) == 0).drop(matches)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark and counts ``n_chars`` anew there; every document stays.

    A document stands for its repository, its source for the owner. Texts are matched by their digest, so equal texts get
    equal answers; those without findings aren't shuffled.
    """
    node, spans = fresh(docs, "text_node"), fresh(docs, "secret_spans")
    keyed = docs.withColumn(node, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = secret_scan.candidates(keyed.select(node, "doc_id", "source", "text"), spans=spans)
    found = settle(found.where(F.size(spans) > 0).drop("text"), "secret-candidates")
    judged = secret_scan.judge(found, F.col("doc_id"), F.col("source"), spans=spans)
    places = settle(judged.where(F.size(spans) > 0).groupBy(node).agg(F.first(spans).alias(spans)), "secret-places")
    names = [f"`{name}`" for name in docs.columns]
    marked = secret_scan.mask(sift(keyed, places, [node]).join(places, node, "left"), spans=spans)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(F.col(spans).isNotNull(), length).otherwise(F.col("n_chars")))
    return sift(keyed, places, [node], keep=False).select(names).unionByName(marked.select(names))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and whether the decoded bytes are the text's (null texts count as empty)."""
    path, pattern = rank_file()
    decoded = bpe.encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier and the fingerprint search have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = settle(docs, f"stage-{at + 1}")
    return docs
