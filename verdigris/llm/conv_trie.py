"""Prefix trie of conversations: one row per distinct sequence of first turns.

Fixed-length block hashing. A conversation is cut into blocks of a few turns; a block is known by the digest of everything
before it and the digest of everything up to its end. Conversations are first grouped by these digests of many turns. Only
where the same beginning goes on with different blocks are the blocks opened and grouped turn by turn; elsewhere each
block's turns take over what is known of the block.

The digest of a prefix is the XOR, in two lanes of 64 bits, of a hash of each turn at its place. It is made up from slices,
so a conversation of any length is worked in parallel; two prefixes of a corpus share one by chance only (it is no defence
against texts made to collide).

Sums over subtrees need no walk of the tree. A node belongs to its smallest member; the nodes of one owner are a path that
ends where its conversation ends. So the sum below a node is the sum over the owners that pass through it, less what the
node's own owner has above it: one more grouping of the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import fraction_of
from verdigris.llm.ordering import numbered, tied
from verdigris.operators.running import running_totals
from verdigris.session import settle

#: Blocks of one conversation whose digests are summed up in one window.
_SLICE = 1024
#: Nodes of one owner's path that are summed up in one window.
_PATH = 8192
_NODE = ["depth", "a", "b"]
_BLOCK = ["k", "from_a", "from_b", "to_a", "to_b", "len"]


def turns_of(df: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 0, ``said`` (digest of role and text) and ``bytes`` of the text, for every row with a conv_id.

    Turns ascend by ``turn``, null first; rows of one turn by role, then by digest, and equal rows all count. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = settle(tied(rows, "tie"), "turns")
    return settle(numbered(rows, ["conv_id"], ["turn", "role", "said", "tie"], "pos").select("conv_id", "pos", "said", "bytes"), "turns")


def with_openings(turns: DataFrame, every: int = 5, parts: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like another one, and the ids of all conversations.

    With h = crc32(id as text) mod ``parts``, conversation c gets the first h turns of conversation c - c mod ``every`` (all if
    it has fewer, none if there is none; the remainder has the sign of c) and its own turns after its first h.
    """
    counts = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    convs = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), fraction_of("conv_id", parts).alias("h"))
    known = counts.select(F.col("conv_id").alias("base"), "n")
    lead = F.least("h", F.coalesce("n", F.lit(0)))
    convs = settle(convs.join(known, "base", "left").select("conv_id", "base", "h", lead.alias("lead")), "conversations")
    first = turns.where(F.col("pos") < parts - 1).withColumnRenamed("conv_id", "base")
    opened = convs.where("lead > 0").join(first, "base").where("pos < lead").select("conv_id", "pos", "said", "bytes")
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "said", "bytes")
    return settle(opened.unionByName(own), "turns"), convs.select("conv_id")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: digests before and after it, and ``steps``, the digest and bytes of each turn."""
    lanes = [F.xxhash64(F.lit(lane), "pos", "said").alias(name) for lane, name in enumerate("ab", 1)]
    k = F.floor(F.col("pos") / block)
    hashed = turns.select("conv_id", k.alias("k"), "pos", *lanes, "bytes")
    cut = hashed.groupBy("conv_id", "k").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("steps")
    )
    cut = settle(cut.withColumn("slice", F.floor(F.col("k") / _SLICE)), "blocks")
    totals = cut.groupBy("conv_id", "slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))

    def before(keys: list[str], order: str, lane: str):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(lane).over(window), F.lit(0))

    shifts = totals.select("conv_id", "slice", *(before(["conv_id"], "slice", lane).alias(f"slice_{lane}") for lane in "ab"))
    inside = cut.select("*", *(before(["conv_id", "slice"], "k", lane).alias(f"block_{lane}") for lane in "ab"))
    start = {lane: F.col(f"slice_{lane}").bitwiseXOR(F.col(f"block_{lane}")) for lane in "ab"}
    placed = inside.join(shifts, ["conv_id", "slice"]).select(
        "conv_id", "k", F.size("steps").alias("len"), "a", "b", "steps", *(start[lane].alias(f"from_{lane}") for lane in "ab")
    )

    def upto(at, lane: str):
        return F.aggregate(F.slice("steps", F.lit(1), at), F.col(f"from_{lane}"), lambda held, step: held.bitwiseXOR(step[lane]))

    steps = F.transform(
        F.sequence(F.lit(1), F.col("len")),
        lambda at: F.struct(upto(at, "a").alias("a"), upto(at, "b").alias("b"), F.element_at("steps", at)["bytes"].alias("bytes")),
    )
    return placed.select(
        "conv_id", "k", "len", "from_a", "from_b",
        *(F.col(f"from_{lane}").bitwiseXOR(F.col(lane)).alias(f"to_{lane}") for lane in "ab"), steps.alias("steps"),
    )


def _opened(blocks: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """The turns of the blocks as nodes with their parents' digests; each has the ``columns`` of its block."""
    steps = blocks.select(*_BLOCK[:3], F.posexplode("steps").alias("at", "step"), "steps", *columns)
    above = F.when(F.col("at") > 0, F.get("steps", F.col("at") - 1))
    return steps.select(
        (F.col("k") * block + F.col("at") + 1).alias("depth"), F.col("step.a").alias("a"), F.col("step.b").alias("b"),
        *(F.coalesce(above[lane], F.col(f"from_{lane}")).alias(f"up_{lane}") for lane in "ab"), F.col("step.bytes").alias("bytes"), *columns,
    )


def _nodes(blocks: DataFrame, forks: DataFrame | None, block: int, measures: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``measures`` (column: aggregate function) over the rows of ``blocks`` that pass through them.

    Whole blocks are grouped first. Those at a fork (the same beginning goes on with different blocks) are opened and
    grouped turn by turn; the others' turns have what the block has. Returns the forks too.
    """
    def folded() -> list:
        return [getattr(F, fold)(name).alias(name) for name, fold in measures.items()]

    grouped = settle(blocks.groupBy(*_BLOCK).agg(F.any_value("steps").alias("steps"), *folded()), "trie-blocks")
    if forks is None:
        forks = grouped.groupBy("k", "from_a", "from_b").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").drop("ways")
        forks = settle(forks, "trie-forks")
    keys = ["k", "from_a", "from_b"]
    straight = _opened(grouped.join(forks, keys, "left_anti"), block, list(measures))
    apart = _opened(grouped.join(forks, keys, "left_semi"), block, list(measures))
    apart = apart.groupBy(*_NODE, "up_a", "up_b", "bytes").agg(*folded())
    return settle(straight.unionByName(apart), "trie-nodes"), forks


def _listed(ends: DataFrame) -> DataFrame:
    """For each node where conversations end: hex SHA-256 of their ids, ascending, comma-joined.

    Ranges of ids are put together in parallel; a node's pieces then stream through one task that keeps the state of the
    hash alone, however many they are.
    """
    placed = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = settle(placed.mapInArrow(_pieces, "depth long, a long, b long, first long, ids string"), "trie-ends")
    dealt = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return dealt.mapInArrow(_hashes, "depth long, a long, b long, ends_sha256 string")


def _pieces(batches: Iterator[pa.RecordBatch], limit: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held, now = [], [], None
        for *node, conv in zip(*(batch.column(name).to_pylist() for name in (*_NODE, "conv_id")), strict=True):
            if held and (node != now or len(held) == limit):
                rows.append((*now, held[0], ",".join(map(str, held))))
                held = []
            now = node
            held.append(conv)
        if held:
            rows.append((*now, held[0], ",".join(map(str, held))))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(column, pa.int64()) for column in list(zip(*rows, strict=True))[:4]), pa.array([row[4] for row in rows], pa.string())],
                names=[*_NODE, "first", "ids"],
            )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(rows: list[tuple]) -> pa.RecordBatch:
        *node, digests = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(one, pa.int64()) for one in node), pa.array(digests, pa.string())], names=[*_NODE, "ends_sha256"])

    now, state = None, None
    for batch in batches:
        rows = []
        for *node, ids in zip(*(batch.column(name).to_pylist() for name in (*_NODE, "ids")), strict=True):
            if node == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                rows.append((*now, state.hexdigest()))
            now, state = node, hashlib.sha256(ids.encode())
        if rows:
            yield given(rows)
    if now is not None:
        yield given([(*now, state.hexdigest())])


def trie(turns: DataFrame, convs: DataFrame, block: int = 4) -> DataFrame:
    """One row per node: ``conv_id`` of its smallest member, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    ``turns`` are (conv_id, pos from 0 without gaps, said, bytes), each (conv_id, pos) once; ``convs`` are all conversations, also
    those without turns, which end at the root. Without conversations there is no root and no row.
    """
    cut = settle(_blocks(turns, block), "blocks")
    whole = cut.groupBy("conv_id").agg(F.sum("len").alias("depth"), F.bit_xor(F.col("from_a").bitwiseXOR(F.col("to_a"))).alias("a"), F.bit_xor(F.col("from_b").bitwiseXOR(F.col("to_b"))).alias("b"))
    ends = convs.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in _NODE))
    ends = settle(ends, "trie-ends")
    # Copies of a conversation are one from here on: the smallest stands for all of them.
    distinct = settle(ends.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")), "trie-distinct")
    kept = settle(cut.join(distinct.select("conv_id", "copies"), "conv_id"), "blocks")

    members = kept.withColumns({"n_convs": F.col("copies"), "owner": F.col("conv_id")})
    found, forks = _nodes(members, None, block, {"n_convs": "sum", "owner": "min"})
    zero = F.lit(0).cast("long")
    root = distinct.agg(F.sum("copies").alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0")
    root = root.select(*(zero.alias(name) for name in _NODE), *(F.lit(None).cast("long").alias(f"up_{lane}") for lane in "ab"), zero.alias("bytes"), "n_convs", "owner")
    found = found.unionByName(root)
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    weighed = found.join(children, _NODE, "left").fillna(0, ["n_children"]).withColumn("saved", saved)
    weighed = settle(weighed.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")
    # What a node's owner has saved above it; an owner's path may be as long as the longest conversation.
    weighed = settle(
        running_totals(weighed, ["owner"], [F.col("depth")], F.floor(F.col("depth") / _PATH), {"path_saved": F.col("saved")}), "trie-nodes"
    )

    owners = settle(weighed.groupBy("owner").agg(F.sum("saved").alias("below"), F.sum("leaf").alias("n_leaves")), "trie-owners")
    passing = kept.join(owners.withColumnRenamed("owner", "conv_id"), "conv_id")
    sums, _ = _nodes(passing, forks, block, {"below": "sum", "n_leaves": "sum"})
    all_of = owners.agg(F.sum("below").alias("below"), F.sum("n_leaves").alias("n_leaves")).select(*(zero.alias(name) for name in _NODE), "below", "n_leaves")
    sums = sums.select(*_NODE, "below", "n_leaves").unionByName(all_of)

    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("parent_conv_id"))
    told = weighed.join(parents, ["depth", "up_a", "up_b"], "left").join(sums, _NODE).join(_listed(ends), _NODE, "left")
    return told.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - (F.col("path_saved") - F.col("saved"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
