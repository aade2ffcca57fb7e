"""Line differences against a longest common subsequence found by hand."""

import random

import pytest

from verdigris.operators import line_diff


def lcs(old, new):
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def edited(dice, old):
    """Moves a block, repeats another, drops and changes lines."""
    new = list(old)
    if len(new) > 4:
        at = dice.randrange(len(new) - 2)
        block = new[at : at + 3]
        del new[at : at + 3]
        place = dice.randrange(len(new) + 1)
        new[place:place] = block
    for _ in range(dice.randrange(4)):
        at = dice.randrange(len(new) + 1)
        new[at : at + dice.randrange(2)] = dice.sample(["", "}", "new", "again"], dice.randrange(3))
    return new


def ranges_of(matched, old, new):
    """Changed lines from matched pairs, as runs."""
    lines = set(range(1, len(new) + 1)) - {b for _, b in matched}
    known, last = dict(matched), 0
    for line in range(1, len(old) + 1):
        last = known.get(line, last)
        if line not in known:
            lines.add(min(last + 1, max(1, len(new))))
    found = []
    for line in sorted(lines):
        if found and line <= found[-1][1] + 1:
            found[-1][1] = line
        else:
            found.append([line, line])
    return {tuple(one) for one in found}


@pytest.fixture(scope="module")
def versions():
    dice = random.Random(4)
    pairs = {}
    for file in range(60):
        old = [dice.choice(["", "}", "return", f"line {at}", f"line {at % 5}"]) for at in range(dice.randrange(30))]
        pairs[file] = (old, edited(dice, old))
    whole = [f"line {at}" for at in range(300)]
    moved = whole[200:] + whole[:200]
    pairs |= {100: (whole, moved), 101: (["a"] * 40, ["a"] * 41), 102: (["x", "y"] * 30, ["y", "x"] * 25), 103: ([], ["n"]), 104: (["o"], []), 105: (["s"], ["s"])}
    pairs[106] = (["u", "", "", "", "v"], ["v", "", "", "", "u"])
    return pairs


def frames(spark, versions):
    side = lambda at: spark.createDataFrame([(file, "\n".join(pair[at])) for file, pair in versions.items()], "file_id long, content string")
    return side(0), side(1)


def seen(lines):
    """The lines that the text has: a final empty piece is none."""
    pieces = "\n".join(lines).split("\n")
    return pieces[:-1] if pieces[-1] == "" else pieces


@pytest.mark.parametrize("exact_pairs", [1 << 16, 0])
def test_matches(spark, versions, exact_pairs):
    old, new = frames(spark, versions)
    rows = line_diff.matched_lines(line_diff.lines_of(old), line_diff.lines_of(new), exact_pairs).collect()
    matched = {}
    for file, a, b in rows:
        matched.setdefault(file, []).append((a, b))
    changes = {}
    for file, start, end in line_diff.revision_line_changes(old, new, exact_pairs).collect():
        changes.setdefault(file, set()).add((start, end))
    for file, pair in versions.items():
        before, after = map(seen, pair)
        pairs = sorted(matched.get(file, []))
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert all(before[a - 1] == after[b - 1] for a, b in pairs)
        # Shortest wherever all pairs were compared, and always where no line is repeated or only one is.
        if exact_pairs > 1000 or file in (100, 101, 103, 104, 105):
            assert len(pairs) == lcs(before, after)
        assert changes.get(file, set()) == ranges_of(pairs, before, after)


def test_a_moved_block_is_one_change(spark):
    old = [f"line {at}" for at in range(100)]
    new = old[10:50] + old[:10] + old[50:]
    changes = line_diff.revision_line_changes(*frames(spark, {1: (old, new)})).collect()
    # Ten lines moved behind forty: they are taken out at the beginning and put in at 41 to 50.
    assert sorted((row["start_line"], row["end_line"]) for row in changes) == [(1, 1), (41, 50)]


def test_one_sided_and_null(spark):
    old = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "x")], "file_id long, content string")
    new = spark.createDataFrame([(2, "c\nd"), (3, None), (4, "n")], "file_id long, content string")
    found = sorted(map(tuple, line_diff.revision_line_changes(old, new).collect()))
    assert found == [(2, 1, 2), (3, 1, 1), (4, 1, 1)]
    assert line_diff.revision_line_changes(old.limit(0), new.limit(0)).count() == 0
