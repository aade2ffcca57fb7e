"""Exact top-k inner-product search: a KD-tree per shard, best-first traversal by box bounds, the kth score carried along."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import settle

_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """No null vector, no null component, none that is NaN or infinite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )


class Tree:
    """A KD-tree over the rows of ``points``: median splits of the widest dimension, a tight box and the least id per node."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.least, self.span, self.child = [], [], [], [], []
        self._split(0, len(ids), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.least = np.array(self.least)

    def _split(self, first: int, last: int, leaf: int) -> int:
        rows = self.points[first:last]
        node = len(self.span)
        low, high = rows.min(0), rows.max(0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(self.ids[first:last].min())
        self.span.append((first, last))
        self.child.append(None)
        if last - first > leaf:
            axis = int(np.argmax(high - low)) if rows.shape[1] else 0
            if rows.shape[1]:
                order = np.argsort(rows[:, axis], kind="stable")
                self.points[first:last] = rows[order]
                self.ids[first:last] = self.ids[first:last][order]
            middle = (first + last) // 2
            self.child[node] = (self._split(first, middle, leaf), self._split(middle, last, leaf))
        return node


class Best:
    """The k best (score, id) of a query so far: higher scores first, ties by smaller id."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []

    def full(self) -> bool:
        return len(self.scores) == self.k

    def add(self, scores: list, ids: list) -> None:
        merged = sorted({(-s, i) for s, i in zip(self.scores + scores, self.ids + ids, strict=True)})[: self.k]
        self.scores, self.ids = [-s for s, _ in merged], [i for _, i in merged]

    def beats(self, bound, least: int) -> bool:
        """Whether a node with this upper bound and least id can still change the result."""
        return not self.full() or bound > self.scores[-1] or bound == self.scores[-1] and least < self.ids[-1]


def search_tree(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, best: list[Best]) -> None:
    """Carries every query's best over one tree. Scores are exact: floats while all sums stay below 2**53, else integers."""
    points, low, high = tree.points, tree.low, tree.high
    top = float(np.abs(queries).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
    if top * max(1, queries.shape[1]) >= 2**53:
        whole = np.vectorize(int, otypes=[object])
        queries, points, low, high = (whole(one) if one.size else one.astype(object) for one in (queries, points, low, high))
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    if not queries.shape[1]:
        bounds = np.zeros((len(queries), len(low)))
    for at, mine in enumerate(best):
        row, own = bounds[at], int(query_ids[at])
        heap = [(-row[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if not mine.beats(-bound, int(tree.least[node])):
                if mine.full() and -bound < mine.scores[-1]:
                    break  # all others have lower bounds still
                continue
            if tree.child[node] is not None:
                for child in tree.child[node]:
                    if mine.beats(row[child], int(tree.least[child])):
                        heapq.heappush(heap, (-row[child], child))
                continue
            first, last = tree.span[node]
            scores = points[first:last] @ queries[at] if queries.shape[1] else np.zeros(last - first)
            ids = tree.ids[first:last]
            keep = ids != own
            if mine.full():
                keep &= (scores >= mine.scores[-1]).astype(bool)
            if keep.any():
                mine.add([max(-_LONG - 1, min(_LONG, int(one))) for one in scores[keep]], ids[keep].tolist())


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(one, np.float64) for one in column])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = 4096, shards_per_task: int = 4, queries_per_task: int = 1024,
) -> DataFrame:
    """The ``k`` rows with the highest inner product for every query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``vectors`` has the key and the vector; other columns play no part. Queries are the rows where ``is_query`` holds,
    candidates all rows with another key. Components become floor(scale * x); scores are exact integer inner products
    (clamped to 64 bits), ties go to the smaller key. Rows with a null key, and vectors that are null or hold a null or
    non-finite component, take no part; vectors of different lengths never meet; equal rows count once; a query with fewer
    candidates has all of them; an empty table has no rows.

    Distinct rows are dealt by key and vector into shards of about ``shard_rows``, however often a key or a vector repeats. A shard is a KD-tree in one
    task. Queries meet the shards in blocks: each task takes a few shards and a block of queries and carries the kth score
    from tree to tree. Every block first searches one group of shards, and takes the kth score found there to all others.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-vectors.count() // shard_rows))
    groups = -(-parts // shards_per_task)
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(F.col(vector), scale).alias("v")
    )
    # Equal rows are one before they are dealt, and rows of one id go wherever their vectors go.
    points = rows.select("id", "v").distinct().withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(parts)))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = frame["v"].map(len)
        for length, part in frame.groupby(lengths):
            tree = Tree(part["id"].to_numpy(np.int64), _matrix(part["v"]))
            out.append({
                "shard": int(part["shard"].iloc[0]), "length": int(length), "ids": tree.ids.tobytes(), "points": tree.points.tobytes(),
                "nodes": np.array([(*span, *(child or (-1, -1))) for span, child in zip(tree.span, tree.child, strict=True)], np.int64).tobytes(),
                "low": tree.low.astype(np.float64).tobytes(), "high": tree.high.astype(np.float64).tobytes(), "least": tree.least.tobytes(),
            })
        return pd.DataFrame(out, columns=["shard", "length", "ids", "points", "nodes", "low", "high", "least"])

    trees = settle(
        points.groupBy("shard").applyInPandas(
            build, "shard long, length long, ids binary, points binary, nodes binary, low binary, high binary, least binary"
        ),
        "kd-trees",
    ).withColumn("group", (F.col("shard") / shards_per_task).cast("long"))
    asked = rows.where("asks").select("id", "v").distinct()
    blocks = max(1, -(-vectors.where(is_query).count() // queries_per_task))
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "kd-queries")

    found_type = "query_id long, vec_id long, score long, slot long"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        opened = [_open(one) for _, one in right.iterrows()]
        for length, part in left.groupby(left["v"].map(len)):
            matrix, ids = _matrix(part["v"]), part["id"].to_numpy(np.int64)
            best = []
            for scores, keys in zip(part["scores"], part["keys"], strict=True):
                mine = Best(k)
                if scores is not None and len(scores):
                    mine.add([int(one) for one in scores], [int(one) for one in keys])
                best.append(mine)
            for size, tree in opened:
                if size == length:
                    search_tree(tree, matrix, ids, best)
            out += [(int(i), vec, score, slot) for i, mine in zip(ids, best, strict=True) for slot, (vec, score) in enumerate(zip(mine.ids, mine.scores, strict=True))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "slot"])

    def meet(queries: DataFrame, tree_tasks: DataFrame) -> DataFrame:
        return queries.groupBy("block", "group").cogroup(tree_tasks.groupBy("block", "group")).applyInPandas(search, found_type)

    every = spark.range(blocks).select(F.col("id").alias("block"), F.pmod(F.col("id"), F.lit(groups)).alias("home"))
    home = asked.join(every, "block").select("id", "v", "block", F.col("home").alias("group"))
    nothing = F.array().cast("array<long>")
    first = meet(
        home.withColumns({"scores": nothing, "keys": nothing}),
        trees.join(every.withColumnRenamed("home", "group"), "group"),
    )
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if groups > 1:
        first = settle(first, "kd-first")
        known = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "score", "vec_id"))).alias("best"))
        others = every.select("block", "home", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).where("group != home")
        bounded = (
            asked.join(known, asked["id"] == known["query_id"], "left")
            .join(others.select("block", F.col("group").cast("long").alias("group")), "block")
            .select("id", "v", "block", "group", F.col("best.score").alias("scores"), F.col("best.vec_id").alias("keys"))
        )
        rest = meet(bounded, trees.join(others.select("block", F.col("group").cast("long").alias("group")), "group"))
        first = first.unionByName(rest).select("query_id", "vec_id", "score").distinct()
    ranked = first.select("query_id", "vec_id", "score", F.row_number().over(by_query).alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _open(row: pd.Series) -> tuple[int, Tree]:
    """A stored tree."""
    tree = Tree.__new__(Tree)
    length = int(row["length"])
    tree.ids = np.frombuffer(row["ids"], np.int64)
    tree.points = np.frombuffer(row["points"], np.float64).reshape(len(tree.ids), length)
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 4).tolist()
    tree.span = [(first, last) for first, last, _, _ in nodes]
    tree.child = [None if left < 0 else (left, right) for _, _, left, right in nodes]
    tree.low = np.frombuffer(row["low"], np.float64).reshape(len(nodes), length)
    tree.high = np.frombuffer(row["high"], np.float64).reshape(len(nodes), length)
    tree.least = np.frombuffer(row["least"], np.int64)
    return length, tree
