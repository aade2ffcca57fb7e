"""Line differences of two versions of files, as joins.

Lines are rows (file_id, seg, line, mark): ``mark`` is the text's digest, and a segment is a run of lines of the old and one of
the new version that may only be matched with each other; at first each file is one segment. What a segment begins and
ends with in both versions is matched. What is left of most segments has few pairs of equal lines, and the longest
increasing chain of all these pairs is a longest common subsequence. Larger segments are cut at anchors, the longest
chain of the lines that stand once in both versions, and their parts are segments of the next round. Only line numbers
ever come together by file, and of a segment at most ``exact_pairs`` or one per line.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import split_lines
from verdigris.operators.intervals import merge_ranges
from verdigris.session import settle

#: A segment with more pairs of equal lines is cut at anchors first.
EXACT_PAIRS = 1 << 16
_SEG = ["file_id", "seg"]


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: numbers of lines take so little room in files that Spark would send whole tables of them to every task."""
    return left.join(right.hint("merge"), on, how)


def lines_of(files: DataFrame) -> DataFrame:
    """``file_id``, ``seg`` 0, ``line`` from 1 and ``mark`` of every line of ``content``; a null content has no lines."""
    each = files.select("file_id", F.posexplode(split_lines(F.coalesce("content", F.lit("")))).alias("at", "text"))
    return each.select("file_id", F.lit(0).cast("long").alias("seg"), (F.col("at") + 1).cast("long").alias("line"), F.unhex(F.md5("text")).alias("mark"))


def _longest_chain(pairs: pd.DataFrame) -> pd.DataFrame:
    """A longest set of pairs that rise in both lines."""
    ordered = pairs.sort_values(["old_line", "new_line"], ascending=[True, False])
    targets = ordered["new_line"].to_list()
    ends: list[int] = []  # least last target of a chain of each length
    rows: list[int] = []  # and the row it stands in
    before: list[int] = []
    for row, target in enumerate(targets):
        length = bisect_left(ends, target)
        before.append(rows[length - 1] if length else -1)
        ends[length : length + 1] = [target]
        rows[length : length + 1] = [row]
    chain, row = [], rows[-1] if rows else -1
    while row >= 0:
        chain.append(row)
        row = before[row]
    return ordered.iloc[chain[::-1]]


def _segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments with lines in both versions: first line and number of lines in each, and how many lines both begin (``head``)
    and end (``tail``) with."""
    def sides(lines: DataFrame, side: str) -> DataFrame:
        return lines.groupBy(*_SEG).agg(F.min("line").alias(f"{side}_first"), F.count(F.lit(1)).alias(f"{side}_n"))

    segments = settle(_join(sides(old, "old"), sides(new, "new"), _SEG), "diff-segments")
    shorter = F.least("old_n", "new_n")

    def agreeing(name: str, place: str, limit) -> DataFrame:
        """Per segment how many lines from its beginning or end on agree, at most ``limit``."""
        at = {side: F.col("line") - F.col(f"{side}_first") if place == "head" else F.col(f"{side}_first") + F.col(f"{side}_n") - 1 - F.col("line") for side in ("old", "new")}
        left = _join(old, segments, _SEG).select(*_SEG, at["old"].alias("at"), "mark")
        right = _join(new, segments, _SEG).select(*_SEG, at["new"].alias("at"), F.col("mark").alias("other"))
        first = _join(left, right, [*_SEG, "at"]).where("mark <> other").groupBy(*_SEG).agg(F.min("at").alias("differs"))
        return _join(segments, first, _SEG, "left").select(*_SEG, F.least(F.coalesce("differs", limit), limit).alias(name))

    ends = _join(_join(segments, agreeing("head", "head", shorter), _SEG), agreeing("tail", "tail", shorter), _SEG)
    return settle(ends.withColumn("tail", F.least("tail", shorter - F.col("head"))), "diff-segments")


def _ends(segments: DataFrame) -> DataFrame:
    """Matches at the beginnings and ends of segments."""
    def run(old, new, n: str) -> DataFrame:
        rows = segments.where(F.col(n) > 0).select("file_id", old.alias("old"), new.alias("new"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("at"))
        return rows.select("file_id", (F.col("old") + F.col("at")).alias("old_line"), (F.col("new") + F.col("at")).alias("new_line"))

    after = {side: F.col(f"{side}_first") + F.col(f"{side}_n") - F.col("tail") for side in ("old", "new")}
    return run(F.col("old_first"), F.col("new_first"), "head").unionByName(run(after["old"], after["new"], "tail"))


def _inner(lines: DataFrame, segments: DataFrame, side: str) -> DataFrame:
    begin = F.col(f"{side}_first") + F.col("head")
    end = F.col(f"{side}_first") + F.col(f"{side}_n") - F.col("tail")
    return _join(lines, segments, _SEG).where((F.col("line") >= begin) & (F.col("line") < end)).select(*lines.columns)


def _recut(lines: DataFrame, anchors: DataFrame, line: str) -> DataFrame:
    """The lines between the anchors of their segment; the anchor before them names the part."""
    held = anchors.select(*_SEG, F.col(line).alias("line"), F.col("old_line").alias("anchor"))
    so_far = Window.partitionBy(*_SEG).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = _join(_join(lines, anchors.select(*_SEG).distinct(), _SEG, "left_semi"), held, [*_SEG, "line"], "left")
    named = marked.withColumn("part", F.coalesce(F.last("anchor", ignorenulls=True).over(so_far), F.col("seg")))
    return named.where("anchor is null").select("file_id", F.col("part").alias("seg"), "line", "mark")


def matched_lines(old: DataFrame, new: DataFrame, exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """``file_id``, ``old_line``, ``new_line``: equal lines that rise in both versions, from ``lines_of`` of each.

    A longest common subsequence wherever the pairs of equal lines of a segment, its common beginning and end aside, are
    at most ``exact_pairs``. In larger ones as many lines as possible of those that stand once in both versions are
    matched first; a larger one without such lines matches the nth occurrence of a line with the nth.
    """
    old, new = settle(old, "diff-lines"), settle(new, "diff-lines")
    found = None
    while True:
        segments = _segments(old, new)
        found = _ends(segments) if found is None else found.unionByName(_ends(segments))
        old, new = settle(_inner(old, segments, "old"), "diff-lines"), settle(_inner(new, segments, "new"), "diff-lines")
        mark = [*_SEG, "mark"]
        counts = _join(old.groupBy(*mark).agg(F.count(F.lit(1)).alias("olds")), new.groupBy(*mark).agg(F.count(F.lit(1)).alias("news")), mark)
        counts = settle(counts.withColumn("once", (F.col("olds") == 1) & (F.col("news") == 1)), "diff-counts")
        kinds = counts.groupBy(*_SEG).agg(F.sum(F.col("olds").cast("double") * F.col("news")).alias("pairs"), F.max("once").alias("anchored"))
        kind = F.when(F.col("pairs") <= exact_pairs, "every").when(F.col("anchored"), "once").otherwise("nth")
        kinds = settle(kinds.select(*_SEG, kind.alias("kind")), "diff-kinds")
        every, once, nth = (kinds.where(F.col("kind") == name).select(*_SEG) for name in ("every", "once", "nth"))

        def sides(which: DataFrame, keys: list[str]) -> list[DataFrame]:
            occurrence = F.row_number().over(Window.partitionBy(*mark).orderBy("line"))
            chosen = [_join(lines, which, keys, "left_semi").select(*mark, F.col("line").alias(name)) for lines, name in ((old, "old_line"), (new, "new_line"))]
            return [one.withColumnRenamed(name, "line").withColumn("nth", occurrence).withColumnRenamed("line", name) for one, name in zip(chosen, ("old_line", "new_line"), strict=True)]

        def paired(which: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
            left, right = sides(which, keys)
            return _join(left, right.drop("nth") if "nth" not in on else right, on).select(*_SEG, "old_line", "new_line")

        single = _join(counts.where("once"), once, _SEG, "left_semi").select(*mark)
        pairs = paired(every, _SEG, mark).unionByName(paired(single, mark, mark)).unionByName(paired(nth, _SEG, [*mark, "nth"]))
        chains = pairs.groupBy(*_SEG).applyInPandas(_longest_chain, pairs.schema)
        chains = settle(chains, "diff-chains")
        found = found.unionByName(chains.select("file_id", "old_line", "new_line"))
        if once.isEmpty():
            return found
        anchors = _join(chains, once, _SEG, "left_semi")
        old, new = settle(_recut(old, anchors, "old_line"), "diff-lines"), settle(_recut(new, anchors, "new_line"), "diff-lines")


def revision_line_changes(old: DataFrame, new: DataFrame, exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """Changed line ranges on the new side of each file, as (file_id, start_line, end_line), from (file_id, content).

    New lines without a match are changed; a removed line marks the line after its last matched predecessor, or the last
    one. Of a line that moved past others, or that stands more often in one version, as few copies as possible are changed.
    A file that is in one version only has all its lines changed, or none.
    """
    before, after = settle(lines_of(old), "diff-lines"), settle(lines_of(new), "diff-lines")
    matched = settle(matched_lines(before, after, exact_pairs), "diff-matches")
    numbers = lambda lines, name: lines.select("file_id", F.col("line").alias(name))
    added = _join(numbers(after, "new_line"), matched, ["file_id", "new_line"], "left_anti").select("file_id", F.col("new_line").alias("start_line"))
    so_far = Window.partitionBy("file_id").orderBy("old_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = new.select("file_id", F.size(split_lines(F.coalesce("content", F.lit("")))).alias("_lines"))
    lost = (
        _join(numbers(before, "old_line"), matched, ["file_id", "old_line"], "left")
        .withColumn("_last", F.last("new_line", ignorenulls=True).over(so_far))
        .where(F.col("new_line").isNull())
    )
    removed = _join(lost, length, "file_id").select(
        "file_id", F.least(F.coalesce("_last", F.lit(0)) + 1, F.greatest(F.lit(1), F.col("_lines"))).alias("start_line")
    )
    return merge_ranges(added.unionByName(removed).withColumn("end_line", F.col("start_line")), ["file_id"])
