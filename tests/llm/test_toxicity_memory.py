"""The driver's share of training: what building the bags takes beside what they hold."""

import tracemalloc

import numpy as np
import pyarrow as pa
from gristmill.llm import toxicity


def test_bags_are_built_in_few_copies():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 14)) for _ in range(300)) for _ in range(250)])
    tracemalloc.start()
    try:
        x, used, _ = toxicity.Bags.build(texts, toxicity.Weights(np.zeros(0, np.uint64), np.zeros(0)), 1)
        held, peak = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        some = x.only(np.arange(0, len(used), 7))
        more = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert peak < 35 * len(x.words.col) and more < 8 * len(x.words.col) and len(some.words.col)


def test_starts_of_sorted_values():
    for values in ([], [4], [0, 0, 3, 3, 3, 9]):
        got, want = toxicity.starts(np.array(values, np.int32)), np.unique(np.array(values, np.int32), return_index=True)
        assert all(np.array_equal(g, w) for g, w in zip(got, want, strict=True))
