"""Keys of repositories and exports hash the ordered texts of their items."""

import hashlib

from pyspark.sql import functions as F

from verdigris.operators import digests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(items):
    leaves = {}
    for item in sorted(set(items)):
        leaves.setdefault(sha(item)[:3], []).append(f"{item}\x1f{items.count(item)}")
    return sha("\x1f".join(f"{bucket}:{sha(chr(31).join(sorted(entries)))}" for bucket, entries in sorted(leaves.items())))


def test_revision_hashes_ordered_texts(spark):
    rows = [("r", f"p{at}", f"s{at % 7}") for at in range(9000)] + [("r", "p1", "s1"), ("one", "a", "b"), ("one", None, "b")]
    got = {row["review_id"]: row["revision"] for row in digests.repo_revision(spark.createDataFrame(rows, "review_id string, path string, sha256 string").repartition(5)).collect()}
    assert got == {"r": tree([f"{path}:{digest}" for key, path, digest in rows if key == "r"]), "one": tree(["a:b"])}


def test_artifact_key_sees_every_table(spark):
    files = spark.createDataFrame([(1, 2, "s")], "review_id int, file_id int, sha256 string")
    revisions = spark.createDataFrame([(1, 3, "t", None)], "review_id int, revision_id int, after_sha256 string, undone_at string")
    decisions = spark.createDataFrame([(1, 4, "fixed")], "review_id int, finding_id int, decision string")
    audits = spark.createDataFrame([(1, 4, "decided", "fixed", "now")], "review_id int, finding_id int, action string, decision string, created_at string")
    reviews = spark.createDataFrame([(1, "done")], "review_id int, status string")
    key = lambda audits, reviews: digests.artifact_key(files, revisions, decisions, audits, reviews).first()["artifact_key"]
    items = ["file:2:s", "revision:3:t:", "decision:4:fixed", "audit:4:decided:fixed:now", "status:done"]
    assert key(audits, reviews) == tree(items)
    told = audits.withColumn("revision_retained", F.lit(True)).withColumn("reason", F.lit("why"))
    assert key(told, reviews.withColumn("summary", F.lit("fine"))) == tree([*items[:3], "audit:4:decided:fixed:now:true:why", "status:done:fine"])
