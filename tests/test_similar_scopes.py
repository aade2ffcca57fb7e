"""Similar names of a scope in one row against the library's matcher and against the joins."""

import difflib
import random

from verdigris.functions.arrow import name_ratio
from verdigris.operators import joins


def test_ratio_is_the_library_s():
    dice = random.Random(4)
    word = lambda most: "".join(dice.choice("abcé_𝛼") for _ in range(dice.randrange(most)))
    pairs = [(word(12), word(12)) for _ in range(5000)] + [(word(300), word(300)) for _ in range(30)]
    assert all(name_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs)


def test_small_scopes_need_no_join_of_names_and_large_ones_agree(spark, monkeypatch):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcd") for _ in range(dice.randrange(9)))
    wanted = [(at % 3 or None, f"f{at % 2}", word()) for at in range(120)] + [(1, "f0", None)]
    visible = [(at % 3 or None, f"f{at % 2}", word()) for at in range(240)] + [(1, "f0", None), (7, "f0", "abcd")]
    sides = [spark.createDataFrame(rows, f"review_id int, file_id string, {name} string") for rows, name in ((wanted, "name"), (visible, "candidate"))]
    similar = joins.similar_names(*sides, ["review_id", "file_id"])
    assert similar._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rows = sorted(map(tuple, similar.collect()))
    want = []
    for review, file, name in set(wanted):
        if review and name:
            ratios = {c: difflib.SequenceMatcher(None, name, c).ratio() for r, f, c in visible if (r, f) == (review, file) and c and c != name}
            best = sorted((-ratio, c) for c, ratio in ratios.items() if ratio >= joins.MIN_SIMILARITY)[:8]
            want += [(review, file, name, c, -ratio, at) for at, (ratio, c) in enumerate(best, 1)]
    assert rows == sorted(want) and len({row[:3] for row in rows if row[5] == 8}) > 5
    for limit in (0, 400):
        monkeypatch.setattr(joins, "SCOPE_PAIRS", limit)
        assert sorted(map(tuple, joins.similar_names(*sides, ["review_id", "file_id"]).collect())) == rows
