"""Queries over whole tables as sets: manifest, conversation trie, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import conv_trie, merkle, warc
from verdigris.llm.common import fraction_of, table
from verdigris.llm.registry import query
from verdigris.session import scratch_path, settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _framed(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _levels(first: str, prefix: str, levels: int) -> str:
    """Level by level over ``first`` (tree, idx, d): runs of sixteen; ``{prefix}{k}`` are the nodes of level k with their run."""
    parts, now = [], first
    for k in range(levels):
        parts.append(
            f"{prefix}n{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, idx // 16 AS up FROM {now}), "
            f"{prefix}r{k} AS (SELECT tree, up, max(n) AS n, list(d ORDER BY idx) AS run FROM {prefix}n{k} GROUP BY tree, up), "
            f"{prefix}u{k} AS (SELECT tree, up AS idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {prefix}r{k})"
        )
        now = f"{prefix}u{k}"
    return ",\n".join(parts)


def _way(prefix: str, levels: int, tree: str, idx: str) -> tuple[str, str, str]:
    """Joins, siblings and folding expression along the way from leaf ``idx`` of ``tree`` to its top."""
    joins, siblings, fold = "", [], "{leaf}"
    for k in range(levels):
        run = f"{prefix}w{k}"
        joins += f" JOIN {prefix}r{k} {run} ON {run}.tree = {tree} AND {run}.up = {idx} // {16 ** (k + 1)}"
        slot = f"(({idx} // {16**k}) % 16)"
        left = f"coalesce(array_to_string({run}.run[1:{slot}], ''), '')"
        right = f"coalesce(array_to_string({run}.run[{slot} + 2:], ''), '')"
        siblings.append(f"CASE WHEN {run}.n = 1 THEN '' ELSE {left} || {right} END")
        fold = f"CASE WHEN {run}.n = 1 THEN {fold} ELSE sha256({left} || {fold} || {right}) END"
    return joins, " || ".join(siblings), fold


#: Levels of sixteen that the SQL spells out: enough for a million rows in a group and for a million groups.
_DEEP = 5
_IN, _IN_SIBLINGS, _ = _way("a", _DEEP, "l.tree", "l.idx")
_UP, _UP_SIBLINGS, _ = _way("b", _DEEP, "0", "t.idx")


def _folds() -> str:
    """Folding spelled out as a chain of columns, because a nested expression would double at every level."""
    parts, now = [], "seen"
    for side, idx in (("a", "idx"), ("b", "tidx")):
        for k in range(_DEEP):
            run, n = f"{side}run{k}", f"{side}n{k}"
            slot = f"(({idx} // {16**k}) % 16)"
            left = f"coalesce(array_to_string({run}[1:{slot}], ''), '')"
            right = f"coalesce(array_to_string({run}[{slot} + 2:], ''), '')"
            parts.append(
                f"{side}f{k} AS (SELECT *, CASE WHEN {n} = 1 THEN {now} ELSE sha256({left} || {now} || {right}) END AS {side}now{k} "
                f"FROM {parts and parts[-1].split(' AS ', 1)[0] or 'ways'})"
            )
            now = f"{side}now{k}"
    return ",\n".join(parts)


_RUNS = ", ".join(f"{s}w{k}.run AS {s}run{k}, {s}w{k}.n AS {s}n{k}" for s in "ab" for k in range(_DEEP))
_SQL11 = f"""
WITH d AS (
  SELECT *, CASE WHEN crc32_of % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS found
  FROM (SELECT *, {{crc}} AS crc32_of FROM documents)),
h AS (
  SELECT doc_id, source, sha256(concat({', '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', 'text')))})) AS d,
    sha256(concat({', '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', 'found')))})) AS seen FROM d),
l AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d, seen) - 1 AS idx, d, seen FROM h),
{_levels('l', 'a', _DEEP)},
t AS (SELECT 0 AS tree, tree AS idx, d FROM au{_DEEP - 1}),
{_levels('t', 'b', _DEEP)},
ways AS (
  SELECT l.doc_id, l.d AS leaf, l.seen, l.idx, t.idx AS tidx, t.d AS subroot, top.d AS root,
    {_IN_SIBLINGS} || {_UP_SIBLINGS} AS proof, {_RUNS}
  FROM l JOIN t ON t.idx = l.tree CROSS JOIN bu{_DEEP - 1} top {_IN} {_UP}),
{_folds()}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, bnow{_DEEP - 1} AS folded_root, bnow{_DEEP - 1} = root AS verified FROM bf{_DEEP - 1}
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII ``text`` in SQL, bit by bit."""
    start = "CAST(4294967295 AS BIGINT)"
    step = "xor(c, CAST(b AS BIGINT))"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))[1]"
    bytes_of = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda c, b: {step}, {start}), CAST(4294967295 AS BIGINT))"


_SQL11 = _SQL11.replace("{crc}", _crc32("coalesce(CAST(doc_id AS VARCHAR), '')"))


@query("op11_merkle", _SQL11)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(fraction_of("doc_id") == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    columns = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    found = merkle.manifest(
        docs, merkle.leaf_digest(*columns, F.col("text")), F.col("doc_id"), F.col("source"), merkle.leaf_digest(*columns, tampered)
    )
    folded = merkle.folded(F.col("seen"), F.col("path"))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_SQL12 = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN o ON o.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o USING (conv_id) WHERE pos >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY depth, node),
e AS (SELECT DISTINCT a.depth, a.node, b.depth AS up, b.node AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
k AS (SELECT up AS depth, parent AS node, count(*) AS n_children FROM e GROUP BY up, parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
s AS (SELECT DISTINCT a.depth, a.node, b.depth AS below, b.node AS inner_node FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
t AS (
  SELECT s.depth, s.node, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.bytes) AS BIGINT) AS saved_tokens
  FROM s JOIN w ON w.depth = s.below AND w.node = s.inner_node GROUP BY s.depth, s.node),
z AS (SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM m GROUP BY conv_id),
x AS (SELECT depth, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM z GROUP BY depth, node)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN t USING (depth, node) LEFT JOIN x USING (depth, node)
  LEFT JOIN e ON e.depth = w.depth AND e.node = w.node LEFT JOIN n up ON up.depth = e.up AND up.node = e.parent
"""


@query("op12_conv_trie", _SQL12)
def op12_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conv_trie.trie(*conv_trie.with_openings(conv_trie.turns_of(said)))


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_DIGITS}', 1 + ((CAST('0x' || substr(sha, {at}, 5) AS BIGINT) // {1 << shift}) % 32), 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0)
)
_SQL13 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS sha, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS FIRST, url NULLS FIRST) AS place FROM p),
o AS (SELECT html, page_id FROM d WHERE place = 1)
SELECT d.page_id, CAST(strlen(d.html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN o.page_id END AS refers_to
FROM d JOIN o USING (html)
"""


@query("op13_warc", _SQL13)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write(warc.records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    found = settle(warc.read(spark, path), "warc-records")
    return warc.resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
