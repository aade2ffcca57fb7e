"""Ranges of lines out of blocks against plain slices."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions.text import split_lines
from verdigris.operators.line_blocks import with_lines


@pytest.mark.parametrize("how", ["inner", "left"])
def test_ranges(spark, how):
    dice = random.Random(2)
    texts = {file: [f"{file}:{line}" for line in range(1, dice.choice([0, 1, 7, 8, 9, 40]) + 1)] for file in range(8)}
    files = spark.createDataFrame([(file, "\n".join(lines), f"p{file}") for file, lines in texts.items()], "file_id int, content string, path string")
    rows = [(at, dice.randrange(9), dice.randrange(1, 45), dice.randrange(1, 45)) for at in range(300)] + [(at, 3, 1, 1000) for at in range(300, 350)] * 2
    df = spark.createDataFrame(rows, "row int, file_id int, start int, end int")
    found = with_lines(df, files, split_lines("content"), F.col("start"), F.col("end"), how=how, also=("path",), block=8)
    got = sorted((row["row"], row["path"], row["_n"], row["_lines"]) for row in found.collect())
    want = []
    for row, file, start, end in rows:
        lines = texts.get(file)
        if lines is not None:
            want.append((row, f"p{file}", len(lines), lines[start - 1 : max(start - 1, end)]))
        elif how == "left":
            want.append((row, None, None, None))
    assert got == sorted(want)
