"""The shorter reported length of repeated strings, and null and repeated keys, against brute force."""

import collections
import random

import numpy as np

from basketwise.llm import repeats


def under(data, length):
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(int(gone.sum()))
    return out


def test_reported_length(spark):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefg hé") for _ in range(n))
    parts = [noise(n) for n in (100, 260, 330, 390, 450, 900)]
    texts = [noise(r.randrange(300)) + r.choice(parts)[r.randrange(40) :] + noise(r.randrange(300)) for _ in range(40)]
    texts += [parts[2], parts[2], "", None, "ab" * 200, noise(100)]
    keys = [None if i % 7 == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, 0) for k, t in zip(keys, texts)], "doc_id long, text string, block int").repartition(3)
    data = [(t or "").encode() for t in texts]
    want = sorted(zip((-1 if k is None else k for k in keys), map(len, data), under(data, 400), under(data, 256), under(data, 157)))
    got = [(-1 if x["doc_id"] is None else x["doc_id"], x["n_bytes"], x["n_removed"], x["n_repeated"]) for x in repeats.remove_repeats(df, report=256).collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in want]
    for (_, size, _, n), (_, _, _, exact, shorter) in zip(sorted(got), want):
        assert exact <= n <= size and (n == 0 or shorter >= 157)
    assert sum(x[3] > x[2] for x in got) > 5 and sum(x[3] == 0 for x in got) > 3
    plain = [(-1 if x["doc_id"] is None else x["doc_id"], x["n_bytes"], x["n_removed"]) for x in repeats.remove_repeats(df, length=130).collect()]
    assert sorted(plain) == sorted(zip((-1 if k is None else k for k in keys), map(len, data), under(data, 130)))
