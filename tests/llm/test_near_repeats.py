"""Near copies that differ in how often a passage repeats."""

import random

from basketwise.llm import near_dedup


def test_repeated_passage():
    r = random.Random(3)
    texts = []
    for _ in range(20):
        words = [f"w{r.randrange(10**6)}" for _ in range(204)]
        texts += [" ".join(words), " ".join(words + words[50:60] * 60)]
    doc, e, c = near_dedup.shingles_of(texts, 5)
    bands = near_dedup.all_bands(doc, e, c, len(texts), 20, 5)
    sets = [set(e[doc == i].tolist()) for i in range(len(texts))]
    for i in range(0, len(texts), 2):
        assert len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])
        assert set(bands[i]) & set(bands[i + 1])
    assert len(bands[0]) == 20 and len(bands[1]) == 40


def test_repeated_passage_is_one_class(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(204)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[50:60] * 60))], "doc_id long, text string")
    assert {x["class_id"] for x in near_dedup.class_rows(docs).collect()} == {1}
