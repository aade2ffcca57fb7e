"""What a shard of the language model holds at once."""

import tracemalloc

import numpy as np
import pandas as pd

from verdigris.llm import ngram_lm


def test_shard_of_the_language_model_holds_a_pair_once():
    dice = np.random.default_rng(5)
    rows = []
    for block in range(40):
        contexts = np.unique(dice.integers(0, 1 << 13, 1250).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        successors = dice.integers(1, 8, len(contexts)).astype("<u4")
        words = np.concatenate([np.sort(dice.integers(0, 60, one)) for one in successors]).astype("<u4")
        packed = {"contexts": contexts, "context_counts": np.full(len(contexts), 7, "<i8"), "successors": successors, "words": words}
        packed["trained"] = (dice.random(len(words)) < 0.8).astype("<u4")
        rows.append({"block": block, "shard": 0, **{name: ngram_lm._pack(values) for name, values in packed.items()}})
    frame = pd.DataFrame(rows)
    pairs = sum(len(ngram_lm._unpack(row["words"], "<u4")) for row in rows)
    tracemalloc.start()
    try:
        ngram_lm._shard_trie(frame, 50.0, 2.0)
        assert tracemalloc.get_traced_memory()[1] < 100 * pairs
    finally:
        tracemalloc.stop()
