"""Lines of files as blocks, so that what looks at a few lines meets a few lines and not its whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def line_blocks(files: DataFrame, lines: Column, block: int = BLOCK) -> DataFrame:
    """``file_id``, ``_block`` and its ``_held`` lines; an empty file is one empty block."""
    whole = files.select("file_id", lines.alias("_all"))
    last = F.greatest(F.lit(0), F.ceil(F.size("_all") / block).cast("int") - 1)
    each = whole.select("file_id", "_all", F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    return each.select("file_id", "_block", F.slice("_all", F.col("_block") * block + 1, F.lit(block)).alias("_held"))


def with_lines(
    rows: DataFrame, files: DataFrame, lines: Column, first: Column, last: Column, where: Column | None = None, how: str = "inner",
    also: tuple[str, ...] = (), block: int = BLOCK,
) -> DataFrame:
    """``rows`` with ``_lines``, the lines ``first`` to ``last`` (numbers from 1) of their file, as far as it has them, and ``_n``, its
    number of lines; ``also`` brings columns of ``files``. ``first``, ``last`` and ``where`` may use ``_n``.

    Rows meet the size of their file first, then the block that their lines lie in. The text of a range over several blocks is
    put together once, however many rows have that range. With ``how`` = ``left`` rows without a file stay, without lines.
    """
    sizes = files.select("file_id", F.size(lines).alias("_n"), *also)
    sized = rows.join(sizes, "file_id", how)
    if where is not None:
        sized = sized.where(where)
    end = F.greatest(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)
    within = lambda line: F.greatest(F.lit(0), F.least(F.floor((line - 1) / block).cast("int"), end))
    placed = sized.withColumns({"_first": first, "_last": last}).withColumns({"_from": within(F.col("_first")), "_to": F.greatest(within(F.col("_first")), within(F.col("_last")))})
    blocks = line_blocks(files, lines, block)
    one = placed.where((F.col("_from") == F.col("_to")) | F.col("_n").isNull()).withColumnRenamed("_from", "_block")
    one = one.join(blocks, ["file_id", "_block"], how).withColumnRenamed("_block", "_from")
    several = placed.where(F.col("_from") < F.col("_to"))
    ranges = several.select("file_id", "_from", "_to").distinct()
    parts = ranges.withColumn("_block", F.explode(F.sequence("_from", "_to"))).join(blocks, ["file_id", "_block"])
    text = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_held"))), lambda part: part["_held"]))
    stitched = parts.groupBy("file_id", "_from", "_to").agg(text.alias("_held"))
    both = one.unionByName(several.join(stitched, ["file_id", "_from", "_to"]))
    asked = F.slice("_held", F.greatest(F.lit(1), F.col("_first") - F.col("_from") * block), F.greatest(F.lit(0), F.col("_last") - F.col("_first") + 1))
    # No lines where the range begins behind the file.
    found = F.when(F.col("_first") <= F.col("_n"), asked).otherwise(F.slice("_held", F.lit(1), F.lit(0)))
    return both.withColumn("_lines", found).drop("_held", "_from", "_to", "_first", "_last")
