"""Merkle manifest of a dataset: a tree of digests per group, a tree of the groups' roots, and a proof for every row.

Nodes are rows (tree, idx, digest). At every level each node computes the indices of its siblings (XOR for two, offsets
of its slot otherwise) and meets them by an equality join of the nodes with themselves; the rows in slot zero, which then
hold their whole run, emit the parents. What a row was joined with is its step of the proof.

Digests travel as 32 bytes and are hashed as lower-case hex text. No node, group or level is ever in one task: a group of
any size is a set of rows (tree, idx), and the driver learns the root and, per level, whether another one follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.ordering import numbered, tied
from verdigris.session import settle


def framed(column: Column) -> Column:
    """A value as hashed: its UTF-8 byte count, ``:`` and itself (numbers as decimal text); ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """Hex SHA-256 of the framed values, one after the other."""
    return F.sha2(F.concat(*map(framed, columns)), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _siblings(idx: Column, arity: int) -> Column:
    """Indices of the other nodes that the run of ``idx`` may have."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1)))
    slot = idx % arity
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda offset: idx - slot + (slot + offset) % arity)


def _met(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with ``left`` and ``right``, the digests of its siblings before and after it, in order, put together."""
    slot = F.col("idx") % arity
    sent = nodes.select("tree", F.explode(_siblings(F.col("idx"), arity)).alias("idx"), slot.alias("from_slot"), F.col("digest").alias("sibling"))
    one = F.when(F.col("sibling").isNotNull(), F.struct("from_slot", "sibling"))
    # The join is dealt by (tree, idx), and so is the aggregate: it needs no exchange of its own.
    met = nodes.join(sent, ["tree", "idx"], "left").groupBy(*nodes.columns).agg(F.sort_array(F.collect_list(one)).alias("met"))

    def joined(which) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("met", which), lambda s: F.hex(s["sibling"])), ""))

    return met.select(
        *nodes.columns,
        joined(lambda s: s["from_slot"] < slot).alias("left"),
        joined(lambda s: s["from_slot"] > slot).alias("right"),
        ((F.col("idx") == 0) & (F.size("met") == 0)).alias("top"),
    )


@dataclass
class Forest:
    """``levels``: the nodes of each level with their siblings, from the leaves on; ``tops``: (tree, digest) of each tree."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int


def grow(nodes: DataFrame, arity: int = 16) -> Forest:
    """Trees over ``nodes`` (tree, idx from 0 without gaps, digest of 32 bytes; other columns stay with the leaves).

    While a tree has several nodes, every ``arity`` consecutive ones (the last run: fewer, even one) become one. A tree of
    one node is its own top. No nodes, no trees: one empty level.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    levels, tops = [], None
    now = nodes
    while True:
        level = settle(_met(now, arity), "merkle-level")
        levels.append(level)
        ended = level.where("top").select("tree", "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        emitted = F.sha2(F.concat(hexed(F.col("digest")), hexed(F.col("right"))), 256)
        parents = level.where((F.col("idx") % arity == 0) & ~F.col("top")).select(
            "tree", (F.col("idx") / arity).cast("long").alias("idx"), F.unhex(emitted).alias("digest")
        )
        if level.where("not top").isEmpty():
            return Forest(levels, tops, arity)
        now = parents


def paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``path``: for each level up to the top, a struct of the digests left and right of the way.

    ``above`` (tree, path and any other columns) continues the way from each tree's top; its columns come along.
    """
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    if above is None:
        above = forest.tops.select("tree", none.alias("path"))
    brought = [column for column in above.columns if column not in ("tree", "path")]
    upper = None
    for at in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[at].withColumn("up", (F.col("idx") / forest.arity).cast("long"))
        own = [column for column in forest.levels[0].columns if column not in ("left", "right", "top")] if at == 0 else ["tree", "idx"]
        now = level.where("top").join(above, "tree").select(*own, "path", *brought)
        if upper is not None:
            step = F.array(F.struct("left", "right"))
            climbed = level.where("not top").join(upper.withColumnRenamed("idx", "up"), ["tree", "up"])
            now = now.unionByName(climbed.select(*own, F.concat(step, "path").alias("path"), *brought))
        upper = settle(now, "merkle-paths") if at else now
    return upper


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its way make."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(hexed(step["left"]), below, hexed(step["right"])), 256))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings as hex text, level by level, left to right; of the empty text where there are none."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(hexed(step["left"]), hexed(step["right"]))), ""), 256)


def manifest(df: DataFrame, leaf: Column, key: Column, group: Column, seen: Column | None = None, arity: int = 16) -> DataFrame:
    """One row per row of ``df``: ``key``, ``leaf``, ``seen``, ``subroot`` of its group, ``root`` of all (hex) and ``path``.

    ``leaf`` is a row's digest (hex), ``seen`` the digest of the row as found now (default: the same). Leaves of a group
    ascend by ``key``, null first; rows of one key by their digests, and equal rows all count, in any order, because they
    are interchangeable. Groups ascend as UTF-8 bytes, null first; null and the empty text are two groups. An empty table
    has no rows and no root. Only the values named here are read, so other columns may have any name.
    """
    seen = leaf if seen is None else seen
    rows = df.select(
        group.cast("string").alias("group"), key.alias("key"), F.unhex(leaf).alias("digest"), F.unhex(seen).alias("seen")
    )
    # The group's own text may be long: its digest stands for it in all joins.
    tree = F.unhex(F.md5(framed(F.col("group")).cast("binary")))
    rows = settle(tied(rows.withColumn("tree", tree), "tie"), "merkle-leaves")
    groups = rows.groupBy("tree").agg(F.min("group").alias("group"))
    nodes = numbered(rows.drop("group"), ["tree"], ["key", "digest", "seen", "tie"], "idx").drop("tie")
    forest = grow(nodes, arity)

    named = settle(forest.tops.join(groups, "tree").select(F.lit(b"").alias("all"), "tree", "group", "digest"), "merkle-groups")
    over = numbered(named.withColumnRenamed("tree", "member"), ["all"], ["group", "member"], "idx")
    whole = grow(over.select(F.col("all").alias("tree"), "idx", "digest", "member"), arity)
    root = whole.tops.first()
    base = settle(
        paths(whole).select(F.col("member").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-groups"
    )
    found = paths(forest, base)
    return found.select(
        "key", hexed(F.col("digest")).alias("leaf"), hexed(F.col("seen")).alias("seen"), hexed(F.col("subroot")).alias("subroot"),
        hexed(F.lit(bytes(root["digest"]) if root else None).cast("binary")).alias("root"), "path",
    )
