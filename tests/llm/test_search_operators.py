"""Repeated spans, language model, KD-trees, fingerprints and containment against brute force, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verdigris.llm import contain, graphs, kd_search, ngram_lm, simhash, spans
from verdigris.llm.common import fraction_of, sift
from verdigris.llm.elias_fano import EliasFano, Trie


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages, exact and edited copies, repeats within a text, nulls, short and very long ones."""
    dice = random.Random(3)
    words = [f"w{n}é" if n % 7 == 0 else f"w{n}" for n in range(400)]
    passage = [dice.choice(words) for _ in range(70)]
    rows = []
    for doc in range(60):
        own = [dice.choice(words) for _ in range(dice.randint(0, 160))]
        if doc % 3 == 0:
            at = dice.randint(0, len(own))
            cut = dice.randint(0, 30)
            own[at:at] = passage[cut:] if doc % 2 else passage[: 70 - cut]
        if doc % 10 == 9:
            own = rows[-1][1].split() if rows[-1][1] else own
            if own:
                own[dice.randrange(len(own))] = "edited"
        rows.append((doc, dice.choice([" ", "\n", "  "]).join(own)))
    rows += [(100, rows[12][1]), (101, rows[12][1]), (102, None), (103, ""), (104, " ".join(words * 40)), (105, " ".join(["again"] * 300))]
    rows += [(106, " ".join(["again"] * 120)), (None, rows[12][1]), (100, rows[12][1]), (101, "other text of one id"), (107, "One two"), (108, "one  TWO")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*row, "clash", 1) for row in corpus], "doc_id long, text string, version string, kept int").repartition(5)


def test_repeated_spans(docs, corpus):
    low = {}
    for doc, text in corpus:
        words = (text or "").encode().split()
        if doc is not None:
            for at in range(len(words) - 49):
                key = tuple(words[at : at + 50])
                low[key] = min(low.get(key, doc), doc)
    want = []
    for doc, text in corpus:
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - 49):
            if doc is not None and low[tuple(words[at : at + 50])] < doc:
                gone |= set(range(at, at + 50))
        left = b" ".join(word for at, word in enumerate(words) if at not in gone)
        want.append((doc, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    found = spans.without_repeats(docs)
    assert found.columns == ["doc_id", "text", "version", "kept", "n_words", "n_removed"]
    got = [(row["doc_id"], row["n_words"], row["n_removed"], hashlib.sha256(row["kept"].encode()).hexdigest()) for row in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(one[2] for one in got) > 500
    assert spans.without_repeats(docs.limit(0)).count() == 0


def test_sift_misses_nothing(spark):
    rows = spark.range(1000).withColumn("sift_word", F.lit(1))
    keys = spark.range(0, 1000, 7)
    inside = {row["id"] for row in sift(rows, keys, ["id"]).collect()}
    outside = {row["id"] for row in sift(rows, keys, ["id"], keep=False).collect()}
    assert set(range(0, 1000, 7)) <= inside and not inside & outside and len(inside | outside) == 1000


def test_elias_fano_against_search():
    dice = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1 << 64), (5, 7), (3000, 1 << 64), (5000, 1 << 12), (3000, 1 << 40)):
        values = np.sort(dice.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
        sequence, _ = EliasFano.open(np.frombuffer(EliasFano.of(values, universe).to_bytes(), np.uint8), 0)
        if n:
            assert (sequence.access(np.arange(n)) == values).all()
        asked = np.concatenate([values, dice.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)])
        at, found = sequence.successor(asked)
        want = np.searchsorted(values, asked)
        assert (found == np.isin(asked, values)).all() and (at[found] == want[found]).all()


def test_trie_maps_a_file(tmp_path):
    dice = np.random.default_rng(5)
    pairs = np.unique(np.stack([dice.integers(0, 50, 800), dice.integers(0, 1 << 32, 800)], 1), axis=0).astype(np.uint64)
    context, word = pairs[:, 0] * np.uint64(1 << 50), pairs[:, 1]
    logs = -dice.random(len(pairs)) * 5
    (tmp_path / "levels").write_bytes(Trie.of(context, word, logs).to_bytes())
    trie = Trie.open(np.memmap(tmp_path / "levels", np.uint8, "r"))
    assert np.abs(trie.logs(trie.codes_of(context, word)) - logs).max() <= 5 / 254
    assert not trie.codes_of(context, word ^ np.uint64(1 << 40)).any() and not trie.codes_of(context + np.uint64(1), word).any()


@pytest.mark.parametrize("block,shard", [(200, 150), (2_000_000, 2_000_000)])
def test_language_model(docs, corpus, block, shard):
    held = [zlib.crc32((str(doc) if doc is not None else "").encode()) % 5 == 1 for doc, _ in corpus]
    tokens = [[*fold(text), None] for _, text in corpus]
    c, pairs, texts = collections.Counter(), collections.Counter(), held.count(False)
    for words, out in zip(tokens, held, strict=True):
        if not out:
            c.update(words)
            pairs.update(zip(["begin", *words[:-1]], words, strict=True))
    total = sum(c.values())
    base = lambda word: (c[word] + 0.5) / (total + 0.5 * (len(c) + 1))
    want = collections.defaultdict(list)
    for (doc, _), words, out in zip(corpus, tokens, held, strict=True):
        score = 0.0
        for before, word in zip(["begin", *words[:-1]], words, strict=True):
            n = texts if before == "begin" else c[before]
            m = 50 + 2 * n
            own = pairs[before, word] if n >= 2 and c[word] >= 2 else 0
            score += math.log10((own + m * base(word)) / (n + m)) if n else math.log10(base(word))
        want[doc].append((out, len(words), sum(word in c for word in words), total, sum(math.log10(base(word)) for word in words), score))
    got = collections.defaultdict(list)
    for row in ngram_lm.score(docs, fraction_of("doc_id") == 1, tokens_per_block=block, entries_per_shard=shard).collect():
        got[row["id"]].append(tuple(row)[1:])
    assert set(got) == set(want)
    for doc, rows in want.items():
        for mine, theirs in zip(sorted(got[doc]), sorted(rows), strict=True):
            assert mine[:4] == theirs[:4]
            assert mine[4] == pytest.approx(theirs[4], rel=1e-9) and mine[5] == pytest.approx(theirs[5], rel=0.01)
    assert ngram_lm.score(docs.limit(0), F.lit(False)).count() == 0


def test_language_model_query_stores_every_pair(spark, tmp_path):
    """A training pair of two words that are seen once counts, too, in the query's score."""
    from verdigris.llm.queries_search import op2_ngram_lm

    ids = [n for n in range(40) if zlib.crc32(str(n).encode()) % 5 != 1][:3]
    texts = ["rare pair", "common common word", "common word again"]
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {row["doc_id"]: row["score"] for row in op2_ngram_lm(spark, str(tmp_path)).collect()}
    c, pairs = collections.Counter(), collections.Counter()
    for text in texts:
        words = [*text.split(), None]
        c.update(words)
        pairs.update(zip(["begin", *words[:-1]], words, strict=True))
    total = sum(c.values())
    p = lambda before, word, n: (pairs[before, word] + (50 + 2 * n) * (c[word] + 0.5) / (total + 0.5 * (len(c) + 1))) / (3 * n + 50)
    assert all(abs(sum(p(before, word, c[before]) for word in c) + (50 + 2 * c[before]) * 0.5 / (total + 0.5 * (len(c) + 1)) / (3 * c[before] + 50) - 1) < 1e-9 for before in ("rare", "common"))
    for doc, text in rows:
        words = [*text.split(), None]
        want = sum(math.log10(p(before, word, 3 if before == "begin" else c[before])) for before, word in zip(["begin", *words[:-1]], words, strict=True))
        assert got[doc] == pytest.approx(want, rel=1e-3)


def brute_top(rows, k, query):
    good = {}
    for key, vector in rows:
        if key is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good[key, tuple(math.floor(256 * float(x)) for x in vector)] = None
    out = []
    for a, va in good:
        if query(a):
            scores = {(sum(x * y for x, y in zip(va, vb, strict=True)), b) for b, vb in good if b != a and len(va) == len(vb)}
            best = sorted(scores, key=lambda one: (-one[0], one[1]))[:k]
            out += [(a, rank + 1, b, score) for rank, (score, b) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size,shards", [(4096, 4), (16, 2)])
def test_kd_search(spark, size, shards):
    dice = random.Random(6)
    rows = [(n, [dice.uniform(-1, 1) for _ in range(6)]) for n in range(150)]
    rows += [(n, [0.5, 0.25, -0.5, 0.0, 1.0, 0.125]) for n in range(200, 260)]  # one vector in very many rows
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0, 2.0]), (306, [2.0, 1.0]), (None, [0.0] * 6), (308, [])]
    rows += [(310, []), (312, [3e30, 0.0]), rows[10], rows[20]]
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], "vec_id long, embedding array<double>, shard int, score string").repartition(6)
    found = kd_search.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=size, shards_per_task=shards, queries_per_task=7)
    got = sorted((row["query_id"], row["rank"], row["vec_id"], row["score"]) for row in found.collect())
    want = [(*one[:3], max(-(1 << 63), min((1 << 63) - 1, one[3]))) for one in brute_top(rows, 5, lambda key: key % 10 == 0)]
    assert got == want
    assert kd_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_one_id_in_a_third_of_all_rows(spark):
    """Its distinct vectors go to many shards; ids beyond 2**53 that round alike stay apart."""
    dice = random.Random(7)
    rows = [(n, [dice.uniform(-1, 1) for _ in range(4)]) for n in range(100)] + [(200, [dice.uniform(-1, 1) for _ in range(4)]) for _ in range(60)]
    rows += [((1 << 60) + n, [0.9, 0.9, 0.9, 0.9]) for n in range(3)] + [(7, rows[7][1])] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = kd_search.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=24, shards_per_task=2, queries_per_task=9)
    got = collections.defaultdict(set)
    for row in found.where("query_id <> 200").collect():
        got[row["query_id"]].add((row["rank"], row["vec_id"], row["score"]))
    want = collections.defaultdict(set)
    for query, rank, vec, score in brute_top(rows, 5, lambda key: key % 10 == 0 and key != 200):
        want[query].add((rank, vec, score))
    assert got == want


def plain_fingerprint(text, shingle):
    words = fold(text)
    runs = [b" ".join(words[at : at + shingle]) for at in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, corpus):
    rows = simhash.with_fingerprint(docs, 3).select("doc_id", "text", simhash.hexadecimal(F.col("fingerprint")).alias("f")).collect()
    assert len(rows) == len(corpus)
    assert all(row["f"] == f"{plain_fingerprint(row['text'], 3):016x}" for row in rows)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_links_lose_nothing(spark, distance):
    dice = random.Random(distance)
    values = {0}
    for _ in range(40):
        centre = dice.getrandbits(64)
        for _ in range(12):
            near = centre
            for _ in range(dice.randint(0, 4)):
                near ^= 1 << dice.randrange(64)
            values.add(near)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in [*signed, *list(signed)[:9], None]], "fingerprint long")
    got = {(row["a"], row["b"], row["distance"]) for row in simhash.links(df, distance).collect()}
    want = {
        (*sorted(pair), ((pair[0] ^ pair[1]) & (2**64 - 1)).bit_count())
        for pair in itertools.combinations(signed, 2) if ((pair[0] ^ pair[1]) & (2**64 - 1)).bit_count() <= distance
    }
    assert got == want


def union_find(nodes, pairs):
    parent = {node: node for node in nodes}

    def find(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def test_components(spark):
    dice = random.Random(12)
    pairs = [(n, n + 1) for n in range(60)] + [(200, n) for n in range(201, 230)] + [(dice.randrange(300, 400), dice.randrange(300, 400)) for _ in range(60)]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3), *pairs[:5]], "a long, b long")
    want = union_find({node for pair in pairs if pair[0] != pair[1] for node in pair}, [p for p in pairs if p[0] != p[1]])
    assert {row["node"]: row["root"] for row in graphs.components(df).collect()} == want
    assert graphs.components(df.limit(0)).count() == 0


def test_groups_of_fingerprints(docs, corpus):
    rows = simhash.group_of(simhash.with_fingerprint(docs, 3)).collect()
    assert len(rows) == len(corpus)
    prints = {row["fingerprint"] & (2**64 - 1) for row in rows}
    root = union_find(prints, [p for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 3])
    low = {}
    for row in rows:
        if row["doc_id"] is not None:
            at = root[row["fingerprint"] & (2**64 - 1)]
            low[at] = min(low.get(at, row["doc_id"]), row["doc_id"])
    assert all(row["component_id"] == low[root[row["fingerprint"] & (2**64 - 1)]] for row in rows)


def test_near_duplicates_against_all_pairs(docs, corpus):
    def shingles(text):
        words = fold(text)
        k = min(5, len(words))
        return frozenset(tuple(words[at : at + k]) for at in range(len(words) - k + 1)) if k else frozenset()

    sets = [shingles(text) for _, text in corpus]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    root = union_find(range(len(corpus)), [p for p in itertools.combinations(range(len(corpus)), 2) if alike(sets[p[0]], sets[p[1]])])
    groups = collections.defaultdict(list)
    for at, (doc, _) in enumerate(corpus):
        groups[root[at]].append(doc)
    want = sorted(min((doc for doc in group if doc is not None), default=None) for group in groups.values())
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(row["doc_id"] for row in kept.collect()) == want
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


def near_groups(texts):
    """Least place of each group of texts that pairs of similarity 0.8 connect, by comparing all pairs."""
    sets = []
    for text in texts:
        words = fold(text)
        k = min(5, len(words))
        sets.append(frozenset(tuple(words[at : at + k]) for at in range(len(words) - k + 1)) if k else frozenset())
    pairs = [p for p in itertools.combinations(range(len(sets)), 2) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]]) - 1e-9]
    root = union_find(range(len(sets)), pairs)
    least = {}
    for at in range(len(sets)):
        least.setdefault(root[at], at)
    return sorted(least.values())


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(row["doc_id"] for row in simhash.without_near_duplicates(df).collect())


def test_near_duplicates_in_a_large_group(spark):
    """Two texts in a family of over 64 that share only the family's passages still meet."""
    template = [f"t{n}" for n in range(60)]
    texts = []
    for n in range(120):
        own = [f"o{n}x{k}" for k in range(12)]
        texts.append(" ".join(template + own))
        if n % 2:
            own[6] = "edited"
            texts.append(" ".join(template + own))
    want = near_groups(texts)
    assert len(want) == 120 and kept_of(spark, texts) == want


def test_near_duplicates_of_short_texts(spark):
    dice = random.Random(11)
    texts = ["", "one", "One ", "one two"]
    for length in range(10, 81):
        words = [f"s{dice.randrange(5000)}" for _ in range(length)]
        texts.append(" ".join(words))
        more = [f"m{dice.randrange(5000)}" for _ in range(max(1, length // 10))]
        texts += [" ".join(words + more), " ".join(more + words), " ".join([*words[: length // 2], "new", *words[length // 2 + 1 :]])]
    want = near_groups(texts)
    assert len(want) < 200 and kept_of(spark, texts) == want


def test_containment(spark, docs, corpus):
    words = next(text for doc, text in corpus if doc == 104).split()
    items = [(1, " ".join(words[10:40])), (2, " ".join(words[100:120] + ["new"] * 2)), (3, " ".join(words[5:20] + ["new"] * 9)), (4, "one two"), (5, ""), (6, None)]
    items += [(7, "ONE TWO"), (8, "again"), (1, items[0][1]), (9, " ".join(["again"] * 30))]
    bench = spark.createDataFrame([(*item, "x") for item in items], "item_id long, text string, matches string")

    def shingles(text, k):
        found = fold(text)
        return {tuple(found[at : at + k]) for at in range(len(found) - k + 1)}

    want = collections.Counter()
    for doc, text in corpus:
        for item, said in set(items):
            k = min(5, len(fold(said)))
            if k:
                own = shingles(said, k)
                shared = len(own & shingles(text, k))
                if shared >= 0.8 * len(own) - 1e-9:
                    want[doc, item, shared, len(own)] += 1
    for parts in (20_000, 3):
        found = contain.with_matches(docs, bench, items_at_once=parts)
        assert found.columns == [*docs.columns, "matches"] and found.count() == len(corpus)
        rows = found.select("doc_id", F.explode("matches").alias("m")).collect()
        assert collections.Counter((row["doc_id"], row["m"]["item_id"], row["m"]["shared"], row["m"]["shingles"]) for row in rows) == want
    assert contain.with_matches(docs, bench.limit(0)).where(F.size("matches") > 0).count() == 0
    assert contain.with_matches(docs.limit(0), bench).count() == 0
