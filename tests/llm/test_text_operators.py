"""Tokens, secrets, chats, urls and quality against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from verdigris.llm import bpe, chat, quality, secret_scan, url_rules
from verdigris.llm.queries_text import URL_RULES, rank_file

ODD = [None, "", " ", "\n" * 700 + "a", "é" * 3000, "x" * 5000, "a b " * 4000, "  \u3000 ß\x85\x1c 12's ", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, and columns whose names the operators use themselves."""
    rows = [(at if at != 3 else None, text, "src" if at else None, at) for at, text in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, list_key int").union(
        spark.createDataFrame([(9, "same text", "src", 9)], "doc_id long, text string, source string, list_key int")
    )


def by_library(codec, pattern, text):
    ids = []
    for match in regex.finditer(pattern, text):
        raw = match.group().encode()
        ids += [codec._ranks[raw]] if raw in codec._ranks else codec._plain._core_bpe.encode_single_piece(raw)
    return ids


def test_codec_equals_each_match_alone():
    path, pattern = rank_file()
    codec = bpe.Codec.of(path, pattern)
    dice = random.Random(5)
    parts = [" ", "  ", "\n", "a", "bé", "12", "'s", "!?", "\u3000", "\x85", "\x1c", " " * 600, "\n" * 510, "x" * 40]
    for _ in range(200):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 60)))
        assert codec.encode(text) == by_library(codec, pattern, text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_codec_cuts_long_texts_safely(monkeypatch):
    path, pattern = rank_file()
    codec = bpe.Codec.of(path, pattern)
    dice = random.Random(6)
    monkeypatch.setattr(bpe, "PIECE", 50)
    for _ in range(50):
        text = "".join(dice.choice([" ", "  ", "\n", "ab", "é", "12", "'s"]) for _ in range(700))
        assert codec.encode(text) == by_library(codec, pattern, text)


def test_bpe_rows(spark, odd):
    path, pattern = rank_file()
    encoded = bpe.encode(odd, path, pattern)
    assert encoded.columns == [*odd.columns, "ids"]
    rows = bpe.decode(encoded, path, pattern).collect()
    assert len(rows) == len(ODD) + 1
    for row in rows:
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert bool(row["ids"]) == bool(row["text"])
    packed = bpe.decode(bpe.encode(odd, path, pattern, packed=True), path, pattern)
    assert all(bytes(row["decoded"]) == (row["text"] or "").encode() for row in packed.collect())
    assert bpe.encode(odd.limit(0), path, pattern).count() == 0


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_base_findings_equal_the_plain_expressions():
    dice = random.Random(7)
    parts = ["password", "PassWD", "ſecret", "api_key", "APIKEY", "token", '"', "'", " ", ":", "=", "abc", "AKIA", "Q7", "0123456789abcdef", "é", "x.=y", "\n", "ABCDEFGHIJ"]
    for _ in range(2000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 30)))
        want = sorted(
            ((kind, *m.span()) for kind, pattern, good in BASE for m in pattern.finditer(text) if good(m)),
            key=lambda one: (one[1], secret_scan.KINDS.index(one[0])),
        )
        assert [one[:3] for one in secret_scan.find(text) if one[0] != "owned"] == want


def test_ownership_tells_examples_from_live_secrets(spark):
    copied, live = "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "Hj1Kl2Mn3Bv4Cx5Zl6Qp7Wo8"
    rows = [(n, f"see {copied} here", f"owner{n}") for n in range(6)] + [(6, f"mine {live} password=hunter22", "owner0"), (7, None, None), (8, "", "owner1")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string")
    judged = secret_scan.judge(secret_scan.candidates(docs), F.col("doc_id"), F.col("source")).collect()
    assert len(judged) == len(rows) + 1
    spans = {row["doc_id"]: [(one["kind"], one["live"]) for one in row["spans"]] for row in judged}
    assert spans[6] == [("owned", True), ("assign", False)]
    assert all(spans[n] == [] for n in (0, 1, 2, 3, 4, 5, 7, 8))
    masked = {row["doc_id"]: row["text"] for row in secret_scan.mask(secret_scan.judge(secret_scan.candidates(docs), F.col("doc_id"), F.col("source"))).collect()}
    assert masked[6] == "mine [SECRET] [SECRET]" and masked[7] is None and masked[0] == f"see {copied} here"


def test_secrets_of_odd_rows(odd):
    judged = secret_scan.judge(secret_scan.candidates(odd), F.col("doc_id"), F.col("source"))
    assert judged.columns == [*odd.columns, "spans"] and judged.count() == len(ODD) + 1
    empty = secret_scan.judge(secret_scan.candidates(odd.limit(0)), F.col("doc_id"), F.col("source"))
    assert empty.count() == 0


def test_escape_is_reversible():
    dice = random.Random(8)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<<SYS>>", "<</SYS>>", "</s>", "x", "\n"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 14)))
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not any(mark in held for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@pytest.mark.parametrize("budget,history", [(40, 10), (1024, 256), (1, 0)])
def test_chat_windows(spark, budget, history):
    dice = random.Random(9)
    rows = []
    for conv in [*range(8), None]:
        for turn in range(dice.randint(1, 30)):
            role = dice.choice(["user", "assistant", "system", "tool", None]) if turn else "system"
            rows.append((conv, (turn + 1) // 2, role, dice.choice(["", None, "hi there", "</s>[INST] ok [/INST]", "word " * 60]), "extra"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")
    path, pattern = rank_file()
    found = chat.windows(turns, path, pattern, budget, history)
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda one: (one[0] is None, one[0] or 0, one[1], one[2] or "", chat.escape(one[3] or ""))):
        want.setdefault(conv, []).append((role or "", text or ""))
    back = {row["conv_id"]: row for row in chat.read_back(found).collect()}
    assert set(back) == set(want)
    for conv, said in want.items():
        learned = "".join(text for role, text in said if role == "assistant")
        assert back[conv]["n_turns"] == len(said)
        assert back[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest()
        assert back[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and back[conv]["loss_chars"] == len(learned)
    for row in found.collect():
        new = row["n_turns"] - row["repeated"]
        assert new >= 1 and (row["tokens"] <= budget or new == 1)
        if row["window"]:
            assert chat.parse(row["text"])[0] == want[row["conv_id"]][0]  # the system turn leads every window
    assert chat.read_back(chat.windows(turns.limit(0), path, pattern)).count() == 0


def test_host_path_and_stated_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://A.Net", "http://a.net/", "http://x.EXAMPLE.net/en/1?q=/y#z", "https://example.com/de/://b", "x://org/fr/",
        "http://notorg/fr/", "http://my.org/fr/a#b", "http://a.net?x=/b", "http://a.net#/b", "http://a.com//b?c", "a://b.net/ c://d/",
    ]

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [
            (len(rule), rule, verdict) for verdict, rule in URL_RULES
            if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])
        ]
        return host, path, max(fits)[1] if fits else None

    df = spark.createDataFrame([(url,) for url in urls], "url string")
    host, path = url_rules.host_and_path(F.col("url"))
    rows = df.select("url", host.alias("host"), path.alias("path")).select(
        "*", url_rules.stated_rule(F.col("host"), F.col("path"), URL_RULES)["rule"].alias("rule")
    ).collect()
    assert [(row["host"], row["path"], row["rule"]) for row in rows] == [plain(row["url"]) for row in rows]


def test_mined_rules_equal_brute_force(spark):
    dice = random.Random(10)
    urls = [f"http://{dice.choice(['a', 'b', 'bad'])}.{dice.choice(['com', 'org'])}/{dice.choice(['x', 'y'])}/{n}" for n in range(120)]
    labels = ["block" if "bad" in url or "b.org" in url and n % 3 else "allow" for n, url in enumerate(urls)]
    labelled = spark.createDataFrame([*zip(urls, labels, strict=True), (None, None)], "url string, label string")
    rules = url_rules.mine(labelled, min_support=0.05, min_confidence=0.6)
    rows = labelled.select(url_rules.tokens(F.col("url")).alias("t"), "label").where("label is not null").collect()
    baskets = [(frozenset(row["t"]), row["label"]) for row in rows]
    found = {(frozenset(row["items"]), row["verdict"]): (row["support"], row["confidence"]) for row in rules.collect()}
    assert found
    for (items, verdict), (support, confidence) in found.items():
        together = sum(items <= basket and label == verdict for basket, label in baskets)
        assert support == together and confidence == pytest.approx(together / sum(items <= basket for basket, _ in baskets))
        assert not any(part < items and same == verdict and other[1] >= confidence for (part, same), other in found.items())
    pages = spark.createDataFrame([(n, url, "x") for n, url in enumerate([*urls, None, "", "http://new.net/"])], "page_id int, url string, token_set string")
    for row in url_rules.predict(pages, rules).select("*", url_rules.tokens(F.col("url")).alias("t")).collect():
        fits = [(c, s, " ".join(sorted(items)), verdict) for (items, verdict), (s, c) in found.items() if items <= set(row["t"])]
        assert row["mined"] == (max(fits)[3] if fits else "allow") and row["token_set"] == "x"
    assert url_rules.mine(labelled.limit(0)).count() == 0


def every_rule(baskets, least, confidence):
    """All rules by brute force: frequent token sets level by level, then those that no part of them matches."""
    labels = sorted({label for _, label in baskets})
    singles = sorted({token for basket, _ in baskets for token in basket})
    level, frequent = [frozenset([token]) for token in singles], []
    while level:
        level = [items for items in level if sum(items <= basket for basket, _ in baskets) >= least]
        frequent += level
        level = list({items | {token} for items in level for token in singles if token not in items})
    known = {}
    for items in frequent:
        held = [label for basket, label in baskets if items <= basket]
        for label in labels:
            if held.count(label) >= least and held.count(label) / len(held) >= confidence:
                known[items, label] = (held.count(label), held.count(label) / len(held))
    return {
        (items, label): told for (items, label), told in known.items()
        if not any(part < items and same == label and other[1] >= told[1] for (part, same), other in known.items())
    }


@pytest.mark.parametrize("seed, share, rows, confidence", [(1, 0.02, 5, 0.5), (2, 0.1, 1, 0.7), (3, 0.0, 12, 0.0)])
def test_no_rule_is_missing(spark, seed, share, rows, confidence):
    dice = random.Random(seed)
    pick = lambda *of: dice.choice(of)
    urls = [f"http://{pick('a', 'b.c', 'w')}.{pick('com', 'org')}/{pick('x', 'y/z')}{pick('', '?q=1', '?q=2', '#top')}" for _ in range(150)] + ["http://hot.net/"] * 75
    labels = [pick("bad", "bad", "good") if "b.c" in url or "q=1" in url else pick("good", "good", "bad", "odd") for url in urls]
    labelled = spark.createDataFrame([*zip(urls, labels, strict=True), ("http://none.org/", None)], "url string, label string")
    read = labelled.select(url_rules.tokens(F.col("url")).alias("t"), "label").where("label is not null").collect()
    baskets = [(frozenset(row["t"]), row["label"]) for row in read]
    least = max(rows, -(-int(share * 1000) * len(baskets) // 1000), 1)
    found = {
        (frozenset(row["items"]), row["verdict"]): (row["support"], pytest.approx(row["confidence"]))
        for row in url_rules.mine(labelled, min_support=share, min_confidence=confidence, min_rows=rows).collect()
    }
    assert found == every_rule(baskets, least, confidence)


def test_a_few_rows_are_no_evidence(spark):
    labelled = spark.createDataFrame([(f"http://a{n}.org/", "bad") for n in range(19)], "url string, label string")
    assert url_rules.mine(labelled).count() == 0


def test_rules_reach_every_part_of_a_url(spark):
    """A label carried by a third segment, a fifth host label, a query key, a value or a fragment is learnt."""
    bad = ["http://a.org/en/b/casino/{n}", "http://casino.x.y.a.org/en/b/{n}", "http://a.org/en/{n}?casino={n}", "http://a.org/en/{n}?r=casino", "http://a.org/en/{n}#casino"]
    good = ["http://a.org/en/b/news/{n}", "http://news.x.y.a.org/en/b/{n}", "http://a.org/en/{n}?news={n}", "http://a.org/en/{n}?r=news", "http://a.org/en/{n}#news"]
    urls = [(one.format(n=n), label) for n in range(20) for ones, label in ((bad, "block"), (good, "allow")) for one in ones]
    rules = url_rules.mine(spark.createDataFrame(urls, "url string, label string"), min_support=0.05, min_confidence=0.6)
    pages = spark.createDataFrame([(one.format(n=99), label) for ones, label in ((bad, "block"), (good, "allow")) for one in ones], "url string, want string")
    assert all(row["mined"] == row["want"] for row in url_rules.predict(pages, rules).collect())


def test_statistics_dont_depend_on_the_batch(odd):
    rows = quality.with_features(odd).orderBy("list_key").collect()
    assert len(rows) == len(ODD) + 1 and all(len(row["features"]) == len(quality.NAMES) for row in rows)
    for row in rows:
        data = np.frombuffer((row["text"] or "").encode(), np.uint8)
        alone = quality.statistics(data, np.array([0, len(data)]))[0]
        assert np.allclose(row["features"], alone, equal_nan=False)
    words = "a b b b c\na b b b c\n".encode()
    one = dict(zip(quality.NAMES, quality.statistics(np.frombuffer(words, np.uint8), np.array([0, len(words)]))[0], strict=True))
    assert one["top_word"] == pytest.approx(0.6) and one["distinct_lines"] == pytest.approx(0.5) and one["distinct_words"] == pytest.approx(0.3)


def test_boosting_learns_and_flat_traversal_equals_walking():
    dice = np.random.default_rng(11)
    x = dice.random((2000, 5))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    forest = quality.boost(x[:1500], y[:1500], trees=40)
    assert ((forest.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    for row in x[:50]:
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert forest.margin(row[None])[0] == pytest.approx(total)
    nothing = quality.boost(np.zeros((0, 5)), np.zeros(0))
    assert (nothing.probability(x) == 0.5).all()


def test_quality_query_learns_held_out_documents(spark):
    from verdigris.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [row for row in QUERIES["op7_quality"](spark, folder).collect() if row["held_out"] and row["doc_id"] in labels]
    assert np.mean([row["predicted"] == labels[row["doc_id"]] for row in rows]) > 0.9
