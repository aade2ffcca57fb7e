"""Queries over single texts: tokens, secrets, urls, conversations, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bpe, chat, quality, secret_scan, url_rules
from verdigris.llm.common import fraction_of, table
from verdigris.llm.registry import query
from verdigris.session import settle


def rank_file() -> tuple[str, str]:
    """Default rank file and split pattern, from the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode(docs, *rank_file(), ids="packed_ids", packed=True, decoded="decoded")
    return decoded.select(
        "doc_id",
        (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _places(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(":", one["kind"], one["start"].cast("string"), one["end"].cast("string"))), ",")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for its repository, its source for the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = settle(secret_scan.candidates(docs).select("doc_id", "source", "spans"), "secret-candidates")
    judged = secret_scan.judge(found, F.col("doc_id"), F.col("source"))
    base = F.filter("spans", lambda one: one["kind"] != "owned")
    count = lambda kind: F.size(F.filter("spans", lambda one: one["kind"] == kind)).cast("long")
    return judged.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_places(base), 256).alias("base_sha256"), _places("spans").alias("spans"),
        F.size(F.filter("spans", lambda one: one["live"])).cast("long").alias("n_live"),
    )


#: The stated rules of the url query. Fixed values.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op8_url_rules")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's url is the document that it shows; that document's label (low quality or toxic) labels the url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]{1,18})(?:[./?#]|$)", 1)
    labelled = (
        pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).join(labels, "doc_id")
        .select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))
    )
    rules = url_rules.mine(labelled)
    host, path = url_rules.host_and_path(F.col("url"))
    stated = url_rules.stated_rule(F.col("host"), F.col("path"), URL_RULES)
    judged = url_rules.predict(pages, rules).select("page_id", host.alias("host"), path.alias("path"), "mined")
    return judged.select("*", stated.alias("stated")).select(
        "page_id", "host", "path", F.col("stated.rule").alias("rule"), F.coalesce("stated.verdict", "mined").alias("verdict")
    )


@query("op4_chat")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat.conversation(spark, -7, [("user", said), ("assistant", said)]))
    return chat.read_back(chat.windows(turns, *rank_file()), arranged=True)


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents, chosen by their id alone, is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = settle(quality.with_features(docs).select("doc_id", "features"), "quality-features")
    labels = quality.labels_of(table(spark, sf_dir, "labels"))
    forest = quality.fit(known.where(fraction_of("doc_id") != 0).join(labels, "doc_id"), "quality", F.col("doc_id"))
    scored = quality.with_score(known, forest, features="features")
    return scored.select(
        "doc_id", (fraction_of("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
