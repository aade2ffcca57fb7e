"""Quotes are tidied once, before they meet the lines of their file."""

from verdigris.operators import intervals


def test_quotes_are_tidied_below_the_joins(spark):
    drafts = spark.createDataFrame(
        [(1, 7, 1, 2, "  two \n"), (2, 7, 1, 3, "two\n three"), (3, 7, 1, 1, " \t"), (4, 7, 1, 2, None), (5, 7, 2, 3, "one")],
        "finding_id int, file_id int, start_line int, end_line int, evidence string",
    )
    files = spark.createDataFrame([(7, "one\na two\nthree")], "file_id int, content string")
    found = intervals.locate_evidence(drafts, files)
    got = {row["finding_id"]: (row["start_line"], row["start_column"], row["end_line"], row["end_column"]) for row in found.collect()}
    assert got == {1: (2, 3, 2, 6), 2: (2, 3, 3, 6)}
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "regexp_replace(evidence" in line:
            below = next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            assert not any("Join" in one for one in lines[at + 1 : below]), line
