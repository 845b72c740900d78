"""Counts beyond 32 bits, sums of nodes by slice, and code lengths."""

import numpy as np
import pyarrow as pa

from basketwise.llm import context_tree


def test_counts_beyond_32_bits():
    keys = np.array([1, 1, 2], np.uint64)
    merged = context_tree._merge(keys, np.array([1 << 33, 5, 7], np.int64))
    assert np.frombuffer(context_tree.word_answer(*merged, np.array([2, 1], np.uint64)), np.int64).tolist() == [7, (1 << 33) + 5]


def test_slices_add_up():
    r = np.random.default_rng(3)
    parts = [(np.unique(r.integers(0, 1 << 16, 300)).astype(np.uint64),) for _ in range(5)]
    parts = [(n, *(r.random(len(n)) for _ in range(3))) for (n,) in parts]
    whole = context_tree.TopNodes(parts)
    by = {}
    for node, *vals in parts:
        for i, at in context_tree._slices(node):
            by.setdefault(i, []).append([x[at].tobytes() for x in (node, *vals)])
    assert len(by) == context_tree.SLICES
    summed = []
    for rows in by.values():
        t = context_tree.sum_nodes(pa.table({c: pa.array([x[i] for x in rows], pa.binary()) for i, c in enumerate(("keys", "below", "zero", "one"))}))
        summed.append(tuple(np.frombuffer(t[c][0].as_py(), k) for c, k in (("keys", np.uint64), ("below", float), ("zero", float), ("one", float))))
    again = context_tree.TopNodes(summed)
    assert (whole.node == again.node).all() and np.allclose(whole.zero, again.zero) and np.allclose(whole.own, again.own) and np.allclose(whole.root_own, again.root_own)


def test_bits_per_byte(spark):
    docs = spark.createDataFrame([(i, f"Some words {i % 3}  here") for i in range(30)] + [(99, None)], "doc_id long, text string")
    for r in context_tree.score_documents(docs, depth=2).collect():
        size = 1 if r["doc_id"] == 99 else len(context_tree.spelled(f"some words {r['doc_id'] % 3} here".encode().split()))
        assert abs(r["bits_per_byte"] - -r["score"] * np.log2(10) / size) < 1e-9
