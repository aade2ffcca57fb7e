"""Manifest, conversation trie and archives against brute force, with odd rows."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import conv_trie, merkle, ordering, warc
from verdigris.session import scratch_path

EMPTY = hashlib.sha256().hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_numbers_of_a_hot_key(spark):
    dice = random.Random(1)
    rows = [(None if at % 7 == 0 else "hot" if at % 3 else f"k{at % 11}", dice.randrange(40) or None, at) for at in range(3000)]
    df = ordering.tied(spark.createDataFrame(rows, "key string, at int, range_part int").repartition(5), "tie")
    found = ordering.numbered(df, ["key"], ["at", "tie"], "no").collect()
    by_key = collections.defaultdict(list)
    for row in found:
        by_key[row["key"]].append((row["no"], -1 if row["at"] is None else row["at"]))
    assert sum(map(len, by_key.values())) == 3000
    for numbers in by_key.values():
        numbers.sort()
        assert [no for no, _ in numbers] == list(range(len(numbers)))
        assert [at for _, at in numbers] == sorted(at for _, at in numbers)


# --- manifest


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """Root of a list of digests, and for each leaf its steps (left, right)."""
    ways, where, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        for leaf, at in enumerate(where):
            run = now[at - at % arity : at - at % arity + arity]
            ways[leaf].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        where = [at // arity for at in where]
        now = [sha("".join(now[at : at + arity])) for at in range(0, len(now), arity)]
    return now[0], ways


def by_hand(rows, arity):
    groups = collections.defaultdict(list)
    for key, group, leaf, seen in rows:
        groups[group].append((key is not None, key or 0, leaf, seen, key))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    tops, ways = {}, {}
    for name in names:
        groups[name].sort()
        tops[name], ways[name] = tree([leaf for _, _, leaf, _, _ in groups[name]], arity)
    root, over = tree([tops[name] for name in names], arity)
    found = []
    for at, name in enumerate(names):
        for (_, _, leaf, seen, key), way in zip(groups[name], ways[name], strict=True):
            steps = way + over[at]
            now = seen
            for left, right in steps:
                now = sha(left + now + right)
            found.append((key, leaf, tops[name], root, sha("".join(left + right for left, right in steps)), now))
    return collections.Counter(found)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, arity):
    dice = random.Random(arity)
    rows = [(at if at % 50 else None, "hot" if at % 3 == 0 else f"s{at % 23}" if at % 19 else None, f"Text {at}") for at in range(400 if arity > 2 else 90)]
    rows += [(1, "hot", "copy")] * 20 + [(5, "", None), (5, "", ""), (6, "long" * 5000, "x" * 100_000), (-3, "alone", "É"), (2**60, "s1", "A")]
    dice.shuffle(rows)
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, source string, text string, idx string, digest int")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("text"))
    found = merkle.manifest(df, leaf, F.col("doc_id"), F.col("source"), merkle.leaf_digest(F.col("doc_id"), lower), arity)
    got = found.select(
        "key", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("seen"), F.col("path")).alias("f")
    ).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [(key, group, sha(framed(key) + framed(text)), sha(framed(key) + framed(text and text.translate(low)))) for key, group, text in rows]
    assert collections.Counter(map(tuple, got)) == by_hand(want, arity)


def test_manifest_of_little(spark):
    one = spark.createDataFrame([(7, None, "A")], "doc_id long, source string, text string")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("text"))
    row = merkle.manifest(one, leaf, F.col("doc_id"), F.col("source")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == sha("1:71:A") and row["path"] == []
    assert merkle.manifest(one.limit(0), leaf, F.col("doc_id"), F.col("source")).count() == 0


# --- trie


def rebuilt_by_hand(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    said = {conv: [(role, text) for _, _, role, _, text in sorted(turns)] for conv, turns in own.items()}
    whole = {}
    for conv, turns in said.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = said.get(conv - (conv % 5 if conv >= 0 else -(-conv % 5)), [])[:h] + turns[h:]
    return whole


def trie_by_hand(whole):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv in sorted(whole):
        for depth in range(len(whole[conv]) + 1):
            members[tuple(whole[conv][:depth])].append(conv)
        ends[tuple(whole[conv])].append(conv)
    children, leaves, saved = collections.Counter(node[:-1] for node in members if node), collections.Counter(), collections.Counter()
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += node not in children
            saved[node[:depth]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return collections.Counter(
        (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node], sha(",".join(map(str, ends[node]))))
        for node, convs in members.items()
    )


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie(spark, block):
    dice = random.Random(block)
    rows = []
    for conv in range(-12, 90):
        for turn in range(dice.randrange(14)):
            rows.append((conv, turn if turn else None, dice.choice(["user", "assistant", None, ""]), dice.choice(["hi", "é ok", None, "", "go on"])))
    # One conversation in a third of all rows, one long text, copies, rows of one turn, no conversation.
    rows += [(1000, turn, "user", f"t{turn // 2}") for turn in range(400)] + [(1003, turn, "user", f"t{turn // 2}") for turn in range(399)]
    rows += [(2000 + at, turn, "user", "same") for at in range(300) for turn in range(3)] + [(41, 3, "user", "again")] * 5
    rows += [(None, 1, "user", "lost"), (42, 99, "user", "x" * 200_000)]
    dice.shuffle(rows)
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], "conv_id long, turn long, role string, text string, pos int, depth string")
    found = conv_trie.trie(*conv_trie.with_openings(conv_trie.turns_of(df)), block=block)
    assert collections.Counter(map(tuple, found.collect())) == trie_by_hand(rebuilt_by_hand(rows))


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conv_trie.trie(*conv_trie.with_openings(conv_trie.turns_of(spark.createDataFrame([], schema)))).count() == 0
    # 4 begins with no turns of 0, which is absent, and drops its own first ones.
    rows = [(4, turn, "user", "a") for turn in range(zlib.crc32(b"4") % 9)]
    alone = conv_trie.trie(*conv_trie.with_openings(conv_trie.turns_of(spark.createDataFrame(rows, schema)))).collect()
    assert [tuple(row) for row in alone] == [(4, 0, None, 1, 0, 1, 0, sha("4"))]


# --- archives


def bare(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def resolved_by_hand(pages, least):
    groups = collections.defaultdict(list)
    for page, url, html in pages:
        groups[html or ""].append((page is not None, page or 0, url is not None, url or "", page))
    found = []
    for html, held in groups.items():
        held.sort()
        for at, (*_, page) in enumerate(held):
            revisit = at > 0 and len(html.encode()) >= least
            found.append((page, len(html.encode()), bare(html), "revisit" if revisit else "response", held[0][-1] if revisit else None))
    return collections.Counter(found)


@pytest.mark.parametrize("least, volume", [(0, 32 << 20), (5, 3000)])
def test_archives(spark, least, volume):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    pages = [(at, f"http://a.org/{at}", f"<p>{at % 40}</p>") for at in range(300)] + [(at, "http://hot.org/", "<hot>") for at in range(1000, 1200)]
    pages += [(None, "http://n", "<p>1</p>"), (9, None, None), (8, "x", ""), (7, "x", "é"), (7, "x", "é"), (7, "w", "é"), (3, "http://u\r\nWARC-Type: forged", tricky)]
    pages += [(2, "u", tricky), (-1, "long", "z" * 300_000), (-2, "long", "z" * 300_000), (6, "x", "\x00\x85 "), (5, "x", "ab"), (5, "x", "ab")]
    random.Random(2).shuffle(pages)
    df = spark.createDataFrame([(*page, 1, "x") for page in pages], "page_id long, url string, html string, tie int, record string").repartition(3)
    path = scratch_path(spark, "test-archives")
    warc.write(warc.records(df, least), path, volume)
    found = warc.resolved(warc.read(spark, path, payloads=True)).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(row[name] for name in names) for row in found) == resolved_by_hand(pages, least)
    assert all(row["intact"] for row in found) and len({row["record_id"] for row in found}) == len(pages)
    html = {(row["payload_digest"]): bytes(row["payload"]).decode() for row in found if row["record_type"] == "response"}
    assert set(html.values()) == {one or "" for _, _, one in pages}
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    volumes = [data for file in files if (data := gzip.decompress(file["content"]))]  # a task without rows leaves an empty file
    records = [fields for data in volumes for fields, _ in warc.parsed(data)]
    kinds = collections.Counter(fields["warc-type"] for fields in records)
    assert kinds["warcinfo"] == len(volumes) and sum(kinds.values()) == len(pages) + len(volumes)
    if volume == 3000:
        assert len(volumes) > 20
    ids = {fields["warc-record-id"] for fields in records}
    assert all(fields["warc-refers-to"] in ids for fields in records if fields["warc-type"] == "revisit")


def test_archives_of_little(spark):
    schema = "page_id long, url string, html string"
    path = scratch_path(spark, "test-archives")
    warc.write(warc.records(spark.createDataFrame([], schema)), path)
    assert warc.read(spark, path).count() == 0
    # A revisit whose response is in none of the archives keeps its header.
    kept = scratch_path(spark, "test-archives")
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same")], schema)
    warc.write(warc.records(pages).where("record like '%revisit%'"), kept)
    row = warc.resolved(warc.read(spark, kept)).first()
    assert (row["page_id"], row["payload_bytes"], row["payload_digest"], row["refers_to"]) == (2, None, bare("same"), None)
