"""URL filters: stated host and path rules, and association rules mined by FP-growth from labelled urls.

Everything is DataFrame code; the mining is Spark ML's FP-growth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import fresh
from verdigris.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the label among the items of a transaction; no url token begins with it.
LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.

    Both are empty for null urls and for urls without ``://``.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    first = lambda text, marks: first(F.substring_index(text, marks[0], 1), marks[1:]) if marks else text
    host = first(rest, "/?#")
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), first(after, "?#")


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.

    ``rules`` are (verdict, host/path) pairs stated by hand. One fits its host and all subdomains where the path starts with
    the rule's, its slash included.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda one: (len(one[1]), one[1])):  # the longest ends up outermost
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """All tokens of a url: scheme, host labels counted from the last, path segments by depth (numbers as ``#``), the file
    extension, whether it has a port or user, a query, a fragment; each query key, each key with its value, the fragment."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda one: F.regexp_replace(one, "[0-9]+", "#"))
    plain = F.substring_index(text, "#", 1)
    asked = F.when(F.instr(plain, "?") > 0, F.substring(plain, F.instr(plain, "?") + 1, F.length(plain))).otherwise("")
    pairs = F.filter(F.split(asked, "[&;]"), lambda one: one != "")
    fragment = F.when(F.instr(text, "#") > 0, F.substring(text, F.instr(text, "#") + 1, F.length(text))).otherwise("")
    numbered = lambda name, values: F.filter(
        F.transform(values, lambda one, at: F.when(one != "", F.concat(F.lit(name), (at + 1).cast("string"), F.lit("="), one))), lambda one: one.isNotNull()
    )
    last = F.element_at(parts, -1)
    made = [F.when(F.instr(text, "://") > 0, F.concat(F.lit("scheme="), F.translate(F.substring_index(text, "://", 1), UPPER, LOWER)))]
    made += [
        F.when(F.instr(last, ".") > 0, F.concat(F.lit("extension="), F.substring_index(last, ".", -1))),
        F.when(host.rlike("[@:]"), F.lit("authority")),
        F.when(F.instr(text, "?") > 0, F.lit("query")),
        F.when(F.instr(text, "#") > 0, F.lit("fragment")),
        F.when(fragment != "", F.concat(F.lit("fragment="), fragment)),
    ]
    keys = F.transform(pairs, lambda one: F.concat(F.lit("key="), F.substring_index(one, "=", 1)))
    values = F.transform(pairs, lambda one: F.concat(F.lit("value="), one))
    every = F.concat(F.array_compact(F.array(*made)), numbered("host", F.reverse(labels)), numbered("path", segments), keys, values)
    return F.array_sort(F.array_distinct(every))


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, url: str = "url", label: str = "label", min_rows: int = 20
) -> DataFrame:
    """Association rules: ``items`` (url tokens), ``verdict``, ``support`` (rows), ``confidence``, and ``key``, the item under
    which the inverted index lists the rule.

    ``labelled`` has one row per labelled url; rows with a null label are left out, repeated rows count each time. A rule needs
    ``min_support`` of the rows and ``min_rows`` at least, because a few rows are no evidence. Of rules with the same verdict,
    one that another with a part of its items matches in confidence is pruned. No labelled rows, no rules.

    Tokens that always stand together (equal count and, in two lanes of 64 bits, equal sum of row hashes) are mined as one:
    a set that holds two of them says no more than one that holds either. A token of every row is a rule by itself and adds
    nothing to others. Every rule over groups is written out again with each of their tokens.
    """
    known = labelled.where(F.col(label).isNotNull())
    rows = known.select(tokens(F.col(url)).alias("items"), F.col(label).cast("string").alias("verdict")).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "url-tokens")
    n = rows.count()
    least = max(min_rows, math.ceil(min_support * n - 1e-9), 1)
    each = rows.select("row", "verdict", F.explode("items").alias("token"))
    lanes = [F.bit_xor(F.xxhash64(F.lit(lane), "row")).alias(name) for lane, name in enumerate("ab")]
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *lanes).where(F.col("freq") >= least)
    # As many at most as one url has tokens, since they all stand in it.
    groups = settle(counted.groupBy("freq", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members")), "url-groups")
    groups = groups.select(F.element_at("members", 1).alias("token"), "members", "freq")

    everywhere = rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    found = (
        groups.where(F.col("freq") == n).select(F.array("token").alias("items"))
        .join(everywhere, F.lit(True)).select("items", "verdict", "support", (F.col("support") / n).alias("confidence"))
    )
    chosen = groups.where(F.col("freq") < n).select("token")
    baskets = each.join(chosen, "token").groupBy("row", "verdict").agg(F.collect_list("token").alias("tokens"))
    baskets = settle(baskets.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items")), "url-baskets")
    if held := baskets.count():
        frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / held), minConfidence=1.0).fit(baskets).freqItemsets
        found = found.unionByName(_unbeaten(settle(frequent, "url-sets")))
    written = _written_out(found.where(F.col("confidence") >= min_confidence), groups.select("token", "members"))
    single = counted.select(F.col("token").alias("key"), F.col("freq").alias("key_freq"))
    keyed = written.select("*", F.explode("items").alias("key")).join(single, "key")
    return keyed.groupBy("items", "verdict", "support", "confidence").agg(F.min_by("key", F.struct("key_freq", "key")).alias("key"))


def _unbeaten(frequent: DataFrame) -> DataFrame:
    """Rules from frequent sets, without those that a rule with a part of their items matches in confidence.

    All sets between a part and the whole are frequent too, so the best confidence among the parts comes up level by level:
    each set asks only those with one item less.
    """
    marked = frequent.select(
        F.filter("items", lambda one: one.startswith(LABEL)).alias("labels"),
        F.array_sort(F.filter("items", lambda one: ~one.startswith(LABEL))).alias("items"),
        "freq",
    ).where(F.size("items") > 0)
    alone = marked.where(F.size("labels") == 0).select("items", F.col("freq").alias("all"))
    rules = marked.where(F.size("labels") == 1).join(alone, "items").select(
        "items", F.expr(f"substring(labels[0], {len(LABEL) + 1})").alias("verdict"), F.col("freq").alias("support"), (F.col("freq") / F.col("all")).alias("confidence")
    )
    rules = settle(rules, "url-rules")
    sizes = rules.agg(F.max(F.size("items"))).first()[0] or 0
    below = kept = rules.where(F.size("items") == 1).withColumn("best", F.col("confidence"))
    for size in range(2, sizes + 1):
        level = rules.where(F.size("items") == size)
        asked = level.select("verdict", F.col("items").alias("whole"), F.explode(F.transform("items", lambda one: F.array_remove("items", one))).alias("items"))
        parts = asked.join(below.select("items", "verdict", "best"), ["items", "verdict"]).groupBy("whole", "verdict").agg(F.max("best").alias("parts"))
        level = settle(level.join(parts.withColumnRenamed("whole", "items"), ["items", "verdict"]), "url-rules")
        below = level.select("items", "verdict", "support", "confidence", F.greatest("confidence", "parts").alias("best"))
        kept = kept.unionByName(below.join(level.where("confidence > parts").select("items", "verdict"), ["items", "verdict"]))
    return kept.drop("best")


def _written_out(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """The rules with every choice of one token from each of their groups."""
    numbered = rules.withColumn("rule", F.struct("items", "verdict"))
    members = numbered.select("rule", "support", "confidence", F.explode("items").alias("token")).join(groups, "token")
    choices = members.groupBy("rule", "support", "confidence").agg(F.collect_list("members").alias("groups"))
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate("groups", none, lambda made, group: F.flatten(F.transform(made, lambda items: F.transform(group, lambda one: F.concat(items, F.array(one))))))
    return choices.select(F.explode(every).alias("items"), F.col("rule.verdict").alias("verdict"), "support", "confidence").withColumn("items", F.array_sort("items"))


#: Bits of the map by which ``predict`` drops url tokens that stand in no rule: 4,096 words, whatever the rules are.
_MAP_BITS = 1 << 18


def _may_be_used(rules: DataFrame):
    """Whether a token may stand in a rule, by a map of fixed size; it never misses one."""
    place = F.pmod(F.xxhash64("item"), F.lit(_MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(item), 64) as int))")
    words = rules.select(F.explode("items").alias("item")).groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    held = ["0"] * (_MAP_BITS // 64)
    for row in words:
        held[row["word"]] = str(row["bits"])
    bits = F.split(F.lit(",".join(held)), ",").cast("array<long>")

    def told(token: Column) -> Column:
        hashed = F.xxhash64(token)
        word = F.get(bits, F.shiftright(F.pmod(hashed, F.lit(_MAP_BITS)), 6).cast("int"))
        return F.getbit(word, F.pmod(hashed, F.lit(64)).cast("int")) == 1

    return told


def predict(pages: DataFrame, rules: DataFrame, url: str = "url", verdict: str = "mined", default: str = "allow") -> DataFrame:
    """``pages`` with the verdict of the best mined rule that fits (confidence, then support, then items), else ``default``.

    Of a url's tokens those that surely stand in no rule are dropped. Distinct sets of the others, far fewer than urls, meet
    the rules through the inverted index: each rule is listed under its rarest item only and verified whole. Every row gets a
    verdict; other columns stay, one called like ``verdict`` is replaced.
    """
    key = fresh(pages, "token_set")
    rules = settle(rules, "url-rules")
    tokened = pages.drop(verdict).withColumn(key, F.filter(tokens(F.col(url)), _may_be_used(rules)))
    best = (
        tokened.select(F.col(key).alias("present")).distinct()
        .select("present", F.explode("present").alias("key"))
        .join(rules.select("items", "verdict", "support", "confidence", "key"), "key")
        .where(F.size(F.array_except("items", "present")) == 0)
        .groupBy("present")
        .agg(F.max_by("verdict", F.struct("confidence", "support", F.array_join("items", " "), "verdict")).alias("best"))
        .select(F.col("present").alias(key), F.col("best").alias(verdict))
    )
    best = settle(best, "url-verdicts")  # a table between, so that a token set of very many urls is split over tasks
    return tokened.join(best, key, "left").withColumn(verdict, F.coalesce(verdict, F.lit(default))).drop(key)
