"""Rare seeds chosen by measured frequency, against the search with all seeds."""

import random

import numpy as np

from basketwise.llm import decontaminate

from .test_leak_recall import COVER, LONG, found, word


def kept_seeds(docs, bench, rare_docs):
    rows = docs.selectExpr("doc_id as k", "text as t")
    own = decontaminate._item_words(bench, "item_id", "text")
    seeds = decontaminate._item_seeds(own, COVER, LONG)
    hit = decontaminate.documents_with(rows, decontaminate.seed_filter(seeds, 1000), list(decontaminate.shapes_of(9)))
    counts = hit.selectExpr("explode(grams) as gram").groupBy("gram").count().withColumnRenamed("count", "n")
    return seeds, counts, decontaminate.rare_seeds(seeds, own, counts, rare_docs, COVER, LONG)


def history(r, common, items, n):
    """Texts with common words everywhere, some with an item, whole or edited."""
    out = []
    for i in range(n):
        text = [word(r) for _ in range(30)]
        text[10:10] = common
        if i % 9 == 0:
            own = items[i % len(items)].split()
            text[20:20] = own if i % 2 else [word(r) if r.random() < 0.2 else w for w in own]
        out.append((i, " ".join(text)))
    return out


def test_rare_seeds_find_what_all_seeds_find(spark):
    r = random.Random(4)
    common = [word(r) for _ in range(8)]
    items = [" ".join([word(r) for _ in range(12)] + common + [word(r) for _ in range(12)]) for _ in range(5)]
    texts = history(r, common, items, 400)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, k) for (i, _), ks in zip(texts, found(items, [t for _, t in texts])) for k in ks}
    assert len(want) > 40
    for seeds in (20, 100_000):
        rows = decontaminate.find_leaks(docs, bench, block_seeds=seeds, rare_docs=20).collect()
        assert {(x["doc_id"], x["item_id"]) for x in rows} == want and len(rows) == len(want)


def test_common_seeds_go(spark):
    r = random.Random(5)
    common = [word(r) for _ in range(8)]
    items = [" ".join([word(r) for _ in range(12)] + common + [word(r) for _ in range(12)]) for _ in range(5)]
    docs = spark.createDataFrame(history(r, common, items, 400), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seeds, counts, rare = kept_seeds(docs, bench, 20)
    n = {x["gram"]: x["n"] for x in counts.collect()}
    shared = set(decontaminate.grams_of(decontaminate.Words()(" ".join(common)), (0, 1, 2)).view(np.int64).tolist())
    assert {n[g] for g in shared} == {400}
    left = {x["gram"] for x in rare.collect()}
    assert not shared & left and 0 < len(left) < seeds.select("gram").distinct().count()


def test_exact_runs_always_hold_a_kept_seed():
    r = random.Random(6)
    for _ in range(300):
        n = r.randrange(1, 70)
        least = decontaminate.least_matches(n, COVER, LONG)
        shapes = decontaminate.shapes_of(least)
        places = [(at, i == 0, r.randrange(5)) for i, s in enumerate(shapes) for at in range(max(n - s[-1], 0))]
        at, first, weight = (np.array(c) for c in zip(*places))
        kept = decontaminate.rare_places(at, weight.astype(float), first, least - shapes[0][-1], 0.5)
        assert kept[weight == 0].all()
        own = set(at[kept & first].tolist())
        for a in range(n - least + 1):
            assert own & set(range(a, a + least - shapes[0][-1]))


def test_items_of_common_words_only(spark):
    """A passage in every document: no seed of it is rare."""
    r = random.Random(7)
    item = " ".join(word(r) for _ in range(30))
    docs = spark.createDataFrame([(i, f"{word(r)} {item} {word(r)}") for i in range(60)] + [(60, "none of it"), (None, item), (None, item), (61, None), (62, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "blue"), (3, None), (4, "")], "item_id long, text string")
    rows = decontaminate.find_leaks(docs, bench, rare_docs=3).collect()
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["item_id"], x["matches"]) for x in rows) == sorted([(i, 1, 30) for i in range(60) for _ in range(2)] + [(-1, 1, 30)] * 4)


def test_documents_that_hold_the_benchmark(spark):
    r = random.Random(8)
    items = [" ".join(word(r) for _ in range(20)) for _ in range(700)]
    docs = spark.createDataFrame([(1, " ".join(items)), (2, items[5])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in rows) == [(1, i) for i in range(700)] + [(2, 5)]


def test_documents_are_scanned_once(spark):
    """Whatever the number of seeds."""
    r = random.Random(9)
    items = [" ".join(word(r) for _ in range(40)) for _ in range(50)]
    read = spark.sparkContext.accumulator(0)
    docs = spark.range(0, 40, 1, 4).selectExpr("id as doc_id", "'a text of few words' as text")

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    # to count the rows asks for them once more, without their texts where they are in files
    docs = docs.mapInPandas(count, docs.schema)
    assert decontaminate.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_seeds=60).count() == 0
    assert read.value == 80  # the scan and the count


def test_grams_stay_in_their_document():
    r = random.Random(3)
    texts = [np.array([r.randrange(6) * 2 + 1 for _ in range(r.choice([0, 0, 1, 2, 3, 9]))], np.uint64) for _ in range(200)]
    shapes = list(decontaminate.shapes_of(9))
    seeds = np.unique(np.concatenate([decontaminate.grams_of(t, s) for t in texts[:60] for s in shapes]))
    mask = decontaminate._mask_of(seeds)
    places, masks = (seeds >> np.uint64(52)).astype(np.int64), np.zeros(1 << 12, np.uint64)
    np.bitwise_or.at(masks, places, mask)
    table = decontaminate.SeedFilter(np.arange(1 << 12), masks, 12)
    for t, own in zip(texts, decontaminate.seeds_in(texts, table, shapes), strict=True):
        grams = np.unique(np.concatenate([decontaminate.grams_of(t, s) for s in shapes]))
        assert own.tolist() == grams[table.hits(grams)].tolist()
        assert set(own) >= set(grams) & set(seeds)
