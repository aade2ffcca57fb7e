"""What near-dedup makes the driver plan."""

import pytest

from verdigris.llm import graphs, simhash


@pytest.fixture
def tables(monkeypatch):
    written = []
    settle = graphs.settle

    def noted(df, name="stage", **how):
        written.append(name)
        return settle(df, name, **how)

    monkeypatch.setattr(graphs, "settle", noted)
    return written


@pytest.mark.parametrize("edges,most", [([], 1), ([(2, 1), (1, 3), (9, 8), (9, 8), (4, 4)], 1), ([(1, 2), (2, 3)], 5)])
def test_components_end_with_the_round_that_makes_stars(spark, tables, edges, most):
    found = {(row["node"], row["root"]) for row in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(group, group)
    assert found == {(node, min(group)) for node, group in want.items()}
    assert len(tables) <= most


def test_near_copies_are_connected_from_roots_not_from_all_links(spark, monkeypatch):
    """Later rounds get a star per group that is known, not every link that made it."""
    seen = []
    components = simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges) or components(edges))
    words = [f"word{n}" for n in range(60)]
    rows = [(n, " ".join([*words[:30], f"mark{n}", *words[30:]])) for n in range(12)] + [(99, "quite another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {row["doc_id"] for row in simhash.without_near_duplicates(docs, least=0.8, shingle=5).collect()}
    assert kept == {0, 99}
    final = seen[-1].where("a <> b")
    assert len(seen) == 3 and final.select("a").distinct().count() == final.count() and final.select("b").distinct().count() == 1
