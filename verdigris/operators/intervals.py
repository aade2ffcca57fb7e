"""Line intervals inside files: containment, overlap, merging, shifting, annotation.

Spans are closed on both ends. Where rows of one file could be many, they are first reduced to the
distinct positions of that file with a map-side aggregate; a file has at most as many positions as lines,
and admission bounds the size of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import split_lines, squash_whitespace
from verdigris.operators.line_blocks import with_lines

# Lines of slack around a changed range; a rule that is always in scope.
CHANGED_LINE_MARGIN = 2
ALWAYS_IN_SCOPE_RULE = "python.syntax-error"

BIN_LINES = 64


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    how: str = "inner",
    also: Column | None = None,
) -> DataFrame:
    """Join points to the intervals that contain them.

    Both sides are cut into bins of lines, so a hot file spreads over its bins. A point lies in exactly
    one bin, hence no pair is found twice.
    """
    binned = intervals.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN_LINES), F.floor(F.col(end) / BIN_LINES)))
    )
    placed = points.withColumn("_bin", F.floor(F.col(point) / BIN_LINES))
    left, right = placed.alias("p"), binned.alias("i")
    on = (F.col("p._bin") == F.col("i._bin")) & F.col(f"p.{point}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    for key in keys:
        on = on & (F.col(f"p.{key}") == F.col(f"i.{key}"))
    if also is not None:
        on = on & also
    joined = left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bin")
    kept = [F.col(f"p.{name}") for name in points.columns]
    kept += [F.col(f"i.{name}") for name in intervals.columns if name not in points.columns]
    return joined.select(*kept)


def findings_in_chunks(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pair each finding with the chunks of its file that contain it completely."""
    inside = F.col("p.end_line") <= F.col("i.target_end_line")
    return point_in_interval(
        findings, chunks, ["file_id"], "start_line", "target_start_line", "target_end_line", also=inside
    )


def overlap_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``overlapping``: how many other findings of the file share a line with this one.

    Counts instead of pairs: starts up to my end, minus ends before my start, minus myself. The work is
    linear however many findings overlap.
    """
    keys = keys or ["file_id"]

    def position(column: str, kind: str) -> DataFrame:
        flag = F.lit(1).cast("long")
        zero = F.lit(0).cast("long")
        return findings.select(
            *keys,
            F.col(column).alias("_line"),
            (flag if kind == "start" else zero).alias("_starts"),
            (flag if kind == "end" else zero).alias("_ends"),
        )

    histogram = (
        position("start_line", "start")
        .unionByName(position("end_line", "end"))
        .groupBy(*keys, "_line")
        .agg(F.sum("_starts").alias("_starts"), F.sum("_ends").alias("_ends"))
    )
    order = Window.partitionBy(*keys).orderBy("_line")
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram.select(
        *keys,
        "_line",
        F.sum("_starts").over(through).alias("_started"),
        F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_ended"),
    )
    at_end = counted.select(*keys, F.col("_line").alias("end_line"), "_started")
    at_start = counted.select(*keys, F.col("_line").alias("start_line"), "_ended")
    joined = findings.join(at_end, [*keys, "end_line"]).join(at_start, [*keys, "start_line"])
    return joined.select(*findings.columns, (F.col("_started") - F.col("_ended") - 1).alias("overlapping"))


def merge_ranges(ranges: DataFrame, keys: list[str], adjacent: int = 1) -> DataFrame:
    """Union of the ranges of each key; ranges closer than ``adjacent`` lines grow together.

    Only the longest range per start line matters, so copies and nested ranges vanish before the shuffle.
    """
    longest = ranges.groupBy(*keys, "start_line").agg(F.max("end_line").alias("end_line"))
    order = Window.partitionBy(*keys).orderBy("start_line")
    reached = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start_line") <= reached + adjacent, 0).otherwise(1)
    island = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        longest.withColumn("_opens", opens)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
        .drop("_island")
    )


def in_review_scope(findings: DataFrame, files: DataFrame, scopes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that belong to what the review was asked to look at.

    ``files``: (review_id, file_id, path). ``scopes``: (review_id, selected_paths, has_ranges), one row per
    review that came from a change; other reviews keep everything. ``ranges``: changed lines per path.
    """
    key = ["review_id", "path"]
    margin = CHANGED_LINE_MARGIN
    merged = (
        merge_ranges(ranges, key)
        .groupBy(*key)
        .agg(F.collect_list(F.struct("start_line", "end_line")).alias("_ranges"))
    )
    known = files.select("review_id", "file_id", F.col("path").alias("_path")).distinct()
    placed = (
        findings.join(known, ["review_id", "file_id"], "left")
        .join(scopes, "review_id", "left")
        .join(merged.withColumnRenamed("path", "_path"), ["review_id", "_path"], "left")
    )
    touches = F.exists(
        F.coalesce("_ranges", F.array().cast("array<struct<start_line:int,end_line:int>>")),
        lambda changed: (F.col("start_line") <= changed["end_line"] + margin)
        & (F.col("end_line") >= F.greatest(F.lit(1), changed["start_line"] - margin)),
    )
    keep = (
        F.when(F.col("selected_paths").isNull(), True)
        .when(F.col("_path").isNull(), False)
        .when(~F.array_contains("selected_paths", F.col("_path")), True)
        .when(~F.col("has_ranges"), True)
        .when(F.col("rule_id") == ALWAYS_IN_SCOPE_RULE, True)
        .otherwise(touches)
    )
    return placed.where(keep).select(*[F.col(name) for name in findings.columns])


def enclosing_symbol(points: DataFrame, symbols: DataFrame, line: str = "line") -> DataFrame:
    """Innermost symbol around each distinct (file, line); ties go to the symbol listed first.

    ``symbols``: (file_id, symbol, ord, start_line, end_line). Equal spans are collapsed first.
    """
    spans = symbols.groupBy("file_id", "start_line", "end_line").agg(
        F.min_by(F.struct("symbol", "ord"), "ord").alias("_first")
    )
    distinct = points.select("file_id", F.col(line).alias("line")).distinct()
    pairs = point_in_interval(distinct, spans, ["file_id"], "line", "start_line", "end_line")
    best = F.min_by(F.col("_first.symbol"), F.struct(F.col("end_line") - F.col("start_line"), F.col("_first.ord")))
    return pairs.groupBy("file_id", "line").agg(best.alias("symbol"))


def line_annotations(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Character range (0-based, end exclusive) of every finding on every line it touches."""
    reached = with_lines(findings, files, F.split("content", "\n", -1), F.col("start_line"), F.col("end_line"), F.col("start_line") <= F.col("_n"))
    rows = reached.select(
        "finding_id", "start_line", "end_line", "start_column", "end_column", F.posexplode("_lines").alias("_at", "_text")
    ).withColumn("line", F.col("start_line") + F.col("_at"))
    length = F.length("_text")
    start = F.when(F.col("line") == F.col("start_line"), F.greatest(F.lit(0), F.col("start_column") - 1)).otherwise(0)
    end = F.when(F.col("line") == F.col("end_line"), F.greatest(start + 1, F.col("end_column") - 1)).otherwise(length)
    return rows.select(
        "finding_id",
        "line",
        F.least(start, length).alias("start_char"),
        F.least(F.greatest(end, start + 1), length).alias("end_char"),
    )


def locate_evidence(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Exact place of the quoted evidence inside the draft's line range; drafts without one are dropped.

    The whole quote on one line wins. Otherwise the first line with the quote's first piece whose end line, as many lines
    below as the quote has newlines but within the range, holds the last piece.
    """
    quote = F.trim(F.regexp_replace("evidence", r"(?U)^\s+|\s+$", ""))
    pieces = split_lines(F.col("_quote"))
    tidy = lambda value: F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    first_line_with = lambda text: F.array_position(F.transform("_range", lambda line: F.instr(line, text) > 0), True)
    in_range = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("_n"))
    # Quotes are tidied before they meet their lines: above that join they would be tidied for every condition on them.
    quoted = drafts.withColumn("_quote", quote).where("_quote <> ''").withColumn("_tight", squash_whitespace(F.col("_quote")))
    narrowed = (
        with_lines(quoted, files, split_lines("content"), F.col("start_line"), F.col("end_line"), in_range)
        .withColumnRenamed("_lines", "_range")
        .where(F.contains(squash_whitespace(F.array_join("_range", " ")), F.col("_tight")))
        .withColumns({"_first": tidy(F.element_at(pieces, 1)), "_last": tidy(F.element_at(pieces, -1))})
        .withColumns({"_whole_at": first_line_with(F.col("_quote")), "_breaks": F.size(F.split("_quote", "\n")) - 1})
    )
    whole = F.col("_whole_at") > 0
    tried = F.transform(
        F.sequence(F.lit(0), F.size("_range") - 1),
        lambda at: F.struct(at.alias("first"), F.least(F.size("_range") - 1, at + F.col("_breaks")).alias("last")),
    )
    fitting = F.filter(
        tried,
        lambda one: (F.instr(F.get("_range", one["first"]), F.col("_first")) > 0) & (F.instr(F.get("_range", one["last"]), F.col("_last")) > 0),
    )
    hit = F.get(fitting, F.lit(0))
    placed = narrowed.withColumn("_hit", F.when(~whole, hit)).withColumns(
        {
            "_from": F.col("start_line") + F.when(whole, F.col("_whole_at").cast("int") - 1).otherwise(F.col("_hit.first")),
            "_to": F.col("start_line") + F.when(whole, F.col("_whole_at").cast("int") - 1).otherwise(F.col("_hit.last")),
        }
    )
    from_text, final_line = F.get("_range", F.col("_from") - F.col("start_line")), F.get("_range", F.col("_to") - F.col("start_line"))
    start_column = F.when(whole, F.instr(from_text, F.col("_quote"))).otherwise(F.instr(from_text, F.col("_first")))
    end_column = F.when(whole, F.instr(from_text, F.col("_quote")) + F.length("_quote")).otherwise(
        F.instr(final_line, F.col("_last")) + F.length("_last")
    )
    kept = [name for name in drafts.columns if name not in ("start_line", "end_line", "start_column", "end_column")]
    place = F.struct(
        F.col("_from").alias("start_line"), start_column.alias("start_column"), F.col("_to").alias("end_line"), end_column.alias("end_column")
    )
    complete = F.col("_from").isNotNull()
    # Exploding the place instead of filtering on it keeps the searches from being copied into a pushed-down filter.
    return placed.select(*kept, F.explode(F.when(complete, F.array(place))).alias("_place")).select(*kept, "_place.*")


def shift_spans(spans: DataFrame, edits: DataFrame, keys: list[str], on_overlap: str = "drop") -> DataFrame:
    """Move spans after the line edits of their file: one row per span, however many edits there are.

    ``edits``: keys, fix_start, fix_end, new_lines, in lines of the text before any of them; edits of a file don't overlap.
    They are applied from top to bottom. A span after an edit shifts by its change of length; one that an edit overlaps is
    dropped (findings) or widened over the replacement (changed ranges). The few edits of a file travel as one array.
    """
    packed = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fix_start", "fix_end", "new_lines"))).alias("_edits"))
    kind = "struct<start:bigint,end:bigint,shift:bigint,hit:boolean>"
    state = F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.lit(0).alias("shift"), F.lit(False).alias("hit")).cast(kind)

    def step(acc: Column, edit: Column) -> Column:
        first, last = edit["fix_start"] + acc["shift"], edit["fix_end"] + acc["shift"]
        delta = edit["new_lines"] - (edit["fix_end"] - edit["fix_start"] + 1)
        before, after = acc["end"] < first, acc["start"] > last
        start = F.when(before, acc["start"]).when(after, acc["start"] + delta).otherwise(F.least(acc["start"], first))
        replaced = first + F.greatest(F.lit(1), edit["new_lines"]) - 1
        end = F.when(before, acc["end"]).when(after, acc["end"] + delta).otherwise(F.greatest(replaced, acc["end"] + delta))
        hit = acc["hit"] | ~(before | after)
        return F.struct(start.alias("start"), end.alias("end"), (acc["shift"] + delta).alias("shift"), hit.alias("hit")).cast(kind)

    none = F.array().cast(packed.schema["_edits"].dataType)
    moved = spans.join(packed, keys, "left").withColumn("_moved", F.aggregate(F.coalesce("_edits", none), state, step))
    if on_overlap == "drop":
        moved = moved.where(~F.col("_moved.hit"))
    types = {name: spans.schema[name].dataType for name in ("start_line", "end_line")}
    return moved.withColumns(
        {"start_line": F.col("_moved.start").cast(types["start_line"]), "end_line": F.col("_moved.end").cast(types["end_line"])}
    ).select(*spans.columns)


def apply_line_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace whole-line spans and rebuild text and hash. ``edits``: file_id, start_line, end_line, replacement.

    The edits of a file must not overlap. They are few, so they travel to their file as an array and the
    text is rebuilt in one row, without exploding lines.
    """
    packed = edits.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("start_line", "end_line", "replacement"))).alias("_edits")
    )
    joined = files.join(packed, "file_id", "left").withColumn("_lines", split_lines("content"))
    changes = F.coalesce("_edits", F.array().cast("array<struct<start_line:int,end_line:int,replacement:string>>"))
    state = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, change: Column) -> Column:
        untouched = F.slice("_lines", acc["next"], F.greatest(F.lit(0), change["start_line"] - acc["next"]))
        added = F.when(change["replacement"] == "", F.array().cast("array<string>")).otherwise(F.array(change["replacement"]))
        return F.struct((change["end_line"] + 1).alias("next"), F.concat(acc["done"], untouched, added).alias("done"))

    finish = lambda acc: F.concat(
        acc["done"], F.slice("_lines", acc["next"], F.greatest(F.lit(0), F.size("_lines") - acc["next"] + 1))
    )
    ending = F.when(F.col("content").endswith("\n"), "\n").otherwise("")
    rebuilt = F.concat(F.array_join(F.aggregate(changes, state, step, finish), "\n"), ending)
    revised = F.when(F.col("_edits").isNull(), F.col("content")).otherwise(rebuilt)
    return joined.withColumn("content", revised).withColumn("sha256", F.sha2("content", 256)).drop("_edits", "_lines")


def line_coverage(significant: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per file: required lines, covered lines, percent, the first missing line, and all missing lines in order.

    ``significant``: (file_id, line). ``chunks``: leaf spans. Less than 100 percent is a failed review.
    """
    spans = chunks.where("status <> 'superseded'").select(
        "file_id", F.col("target_start_line").alias("start_line"), F.col("target_end_line").alias("end_line")
    )
    merged = merge_ranges(spans, ["file_id"])
    distinct = significant.select("file_id", "line").distinct()
    inside = point_in_interval(distinct, merged, ["file_id"], "line", "start_line", "end_line", "left")
    covered = F.count("start_line")
    required = F.count(F.lit(1))
    return inside.groupBy("file_id").agg(
        required.alias("required"),
        covered.alias("covered"),
        (covered * 100 / required).alias("percent"),
        F.min(F.when(F.col("start_line").isNull(), F.col("line"))).alias("first_missing_line"),
        F.sort_array(F.collect_list(F.when(F.col("start_line").isNull(), F.col("line")))).alias("missing_lines"),
    )


def parse_error_gate(error_ranges: DataFrame, files: DataFrame, max_ratio: float = 0.15) -> DataFrame:
    """Files whose unparsable bytes exceed the allowed share. ``error_ranges``: file_id, error_bytes."""
    errors = error_ranges.groupBy("file_id").agg(F.sum(F.greatest(F.lit(1), F.col("error_bytes"))).alias("error_bytes"))
    size = F.greatest(F.lit(1), F.octet_length("content"))
    return (
        files.select("file_id", size.alias("size"))
        .join(errors, "file_id")
        .select("file_id", "error_bytes", "size", (F.col("error_bytes") / F.col("size") > max_ratio).alias("rejected"))
    )
