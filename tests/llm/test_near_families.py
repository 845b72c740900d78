"""Families larger than a block, with members unlike their first text, and clashing names."""

import random

from pyspark.sql import functions as F

from basketwise.llm import near_dedup


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_families_in_small_blocks(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = [word() for _ in range(120)]
    rows = []
    for i in range(60):  # each a word away from the one before: the ends are unlike the first
        text = list(text)
        text[(2 * i) % 120] = word()
        rows.append(" ".join(text))
    rows += [rows[0]] * 3 + [" ".join(word() for _ in range(40)) for _ in range(10)] + [None, "", None]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, k string, row int")
    sets = [shingles(t or "") for t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    smallest = {g: min(i for i in range(len(rows)) if group[i] == g) for g in group}
    for block in (5, 400):
        got = {x["doc_id"]: x["class_id"] for x in near_dedup.class_rows(docs, block=block).collect()}
        assert got == {i: smallest[group[i]] for i in range(len(rows))}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(smallest.values()))
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") < 60, F.col("doc_id")))
    assert near_dedup.class_rows(twice).count() == 2 * len(rows)
