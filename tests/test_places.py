"""Evidence places, shifted spans, missing lines and the streamed limiter against plain loops; bindings keep every row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import intervals
from verdigris.plans.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def place_of(content, start, end, evidence):
    quote = evidence.strip()
    lines = content.splitlines()
    part = lines[start - 1 : end]
    flat = lambda text: re.sub(r"\s+", " ", text).strip()
    if not quote or flat(quote) not in flat("\n".join(part)):
        return None
    for at, line in enumerate(part):
        if quote in line:
            return start + at, line.index(quote) + 1, start + at, line.index(quote) + len(quote) + 1
    pieces = [piece.strip() for piece in quote.splitlines()]
    for at, line in enumerate(part):
        to = min(len(part) - 1, at + quote.count("\n"))
        if pieces[0] in line and pieces[-1] in part[to]:
            return start + at, line.index(pieces[0]) + 1, start + to, part[to].index(pieces[-1]) + len(pieces[-1]) + 1
    return None


def test_evidence_goes_on_to_later_lines(spark):
    dice = random.Random(21)
    files, drafts = [], []
    for number in range(60):
        lines = [dice.choice(["foo(", "x", "bar)", "  foo(", "foo( y", "", "bar) z"]) for _ in range(7)] + ["bar)"]
        files.append((number, "\n".join(lines)))
        for k in range(6):
            start = dice.randint(1, 6)
            end = dice.randint(start, 8)
            quote = dice.choice(["foo(\nbar)", "foo(\nx\nbar)", "x\nfoo(", "bar)", "foo( \n bar)", "\n"])
            drafts.append((number, f"{number}-{k}", start, end, 1, 1, quote))
    files.append((100, "foo(\nx\nfoo(\nbar)"))
    drafts.append((100, "again", 1, 4, 1, 1, "foo(\nbar)"))
    got = intervals.locate_evidence(
        spark.createDataFrame(drafts, "file_id int, finding_id string, start_line int, end_line int, start_column int, end_column int, evidence string"),
        spark.createDataFrame(files, "file_id int, content string"),
    ).collect()
    found = {row["finding_id"]: (row["start_line"], row["start_column"], row["end_line"], row["end_column"]) for row in got}
    texts = dict(files)
    want = {one[1]: place_of(texts[one[0]], one[2], one[3], one[6]) for one in drafts}
    assert found == {key: value for key, value in want.items() if value}
    assert found["again"] == (3, 1, 4, 5)


@pytest.mark.parametrize("mode", ["drop", "widen"])
def test_spans_pass_every_edit_of_their_file(spark, mode):
    dice = random.Random(22)
    edits, spans, want = [], [], {}
    for number in range(40):
        own, line = [], 1
        while line < 60 and len(own) < dice.randint(0, 6):
            first = line + dice.randint(1, 9)
            own.append((number, first, first + dice.randint(0, 4), dice.randint(0, 6)))
            line = own[-1][2] + 1
        edits += own
        for k in range(10):
            start = dice.randint(1, 60)
            end = start + dice.randint(0, 12)
            spans.append((number, f"{number}-{k}", start, end))
            shift, hit = 0, False
            for _, first, last, new in own:
                first, last, delta = first + shift, last + shift, new - (last - first + 1)
                if start > last:
                    start, end = start + delta, end + delta
                elif end >= first:
                    hit = True
                    start, end = min(start, first), max(first + max(1, new) - 1, end + delta)
                shift += delta
            if mode == "widen" or not hit:
                want[f"{number}-{k}"] = (start, end)
    dice.shuffle(edits)
    moved = intervals.shift_spans(
        spark.createDataFrame(spans, "file_id int, finding_id string, start_line int, end_line int"),
        spark.createDataFrame(edits, "file_id int, fix_start int, fix_end int, new_lines int"), ["file_id"], mode,
    ).collect()
    assert len(moved) == len(want) and {row["finding_id"]: (row["start_line"], row["end_line"]) for row in moved} == want


def test_missing_lines_are_listed(spark):
    significant = spark.createDataFrame([(1, line) for line in (1, 2, 4, 7, 9, 9)], "file_id int, line int")
    chunks = spark.createDataFrame([(1, 2, 4, "completed"), (1, 8, 8, "completed"), (1, 1, 9, "superseded")], "file_id int, target_start_line int, target_end_line int, status string")
    row = intervals.line_coverage(significant, chunks).first()
    assert (row["first_missing_line"], list(row["missing_lines"])) == (1, [1, 7, 9])


def test_bindings_keep_every_row(spark):
    tables = Tables(spark, FOLDER)
    assert tables.text_findings.count() == tables.raw("lineitem").count()
    assert tables.text_findings.where(F.col("file_id").isNull()).count() == 0
    from verdigris.plans.admission_queries import response_log

    assert response_log(tables).count() == tables.attempts.count()
