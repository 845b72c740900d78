"""Decision lists whose order matters, a rejecting default, and labels of repeated keys."""

import numpy as np

from basketwise.llm import quality_rules

NAMES = ["symbol_share", "upper_share", "digit_share"]


def verdicts(rules, x):
    out, open_ = np.ones(len(x), bool), np.ones(len(x), bool)
    for r in rules:
        c = quality_rules._covered(r.tests, x, NAMES) & open_
        out[c], open_ = r.keep, open_ & ~c
    return out


def test_exception_before_a_rejection():
    x = np.random.default_rng(1).random((3000, 3))
    good = (x[:, 0] < 0.4) | ((x[:, 1] > 0.3) & (x[:, 1] < 0.5) & (x[:, 2] < 0.6))
    rules = quality_rules.learn_rules(x, good, NAMES)
    assert {r.keep for r in rules} == {True, False}
    fresh = np.random.default_rng(2).random((3000, 3))
    want = (fresh[:, 0] < 0.4) | ((fresh[:, 1] > 0.3) & (fresh[:, 1] < 0.5) & (fresh[:, 2] < 0.6))
    assert (verdicts(rules, fresh) == want).mean() > 0.97
    assert (verdicts(rules[::-1], fresh) == want).mean() < 0.9
    again = np.random.default_rng(5).permutation(3000)
    assert quality_rules.learn_rules(x[again], good[again], NAMES) == rules


def test_default_and_ties(spark):
    x = np.repeat(np.array([[0.1, 0, 0], [0.9, 0, 0]]), 50, axis=0)
    good = np.arange(100) < 50
    rules = quality_rules.learn_rules(x, good, NAMES)
    assert verdicts(rules, x).tolist() == good.tolist()
    assert verdicts(quality_rules.learn_rules(x, ~good | True, NAMES), x).all()
    assert not verdicts(quality_rules.learn_rules(x, good & False, NAMES), x).any()
    assert quality_rules.learn_rules(x[:0], good[:0], NAMES) == []
    same = quality_rules.learn_rules(x * 0, good, NAMES)
    assert same == []


def test_repeated_keys_and_clashing_names(spark):
    bad = " ".join(f"w{i} # $" for i in range(60))
    fine = " ".join(f"word{i} is here." for i in range(40))
    rows = [(i, bad if i % 4 == 0 else fine + f" {i}", 5) for i in range(200)] + [(1, bad, 5)] * 300 + [(None, fine, 5), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(7, None), (None, 1), (3, 1)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, labels)
    judged = quality_rules.judge(docs, rules)
    assert judged.columns[:3] == ["doc_id", "text", "label"]
    assert {(r["doc_id"], r["_quality_kept"]) for r in judged.where("doc_id > 1").collect()} == {(i, i % 4 > 0) for i in range(2, 200)}
    assert [r["_quality_kept"] for r in judged.where("text is null").collect()] == [False]
