"""Language model, line dedup, near dedup, decontamination, repeated strings and the pipeline against brute force."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.llm import context_tree, decontaminate, line_dedup, near_dedup, repeats, workspace

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, grp string")


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_groups(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)]
    got = {x["node"]: x["grp"] for x in workspace.connected_groups(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    real = [(a, b) for a, b in pairs if a != b]
    assert got == groups_of(real, {n for p in real for n in p})


# ---- context trees ----------------------------------------------------------------------------------------------


def plain_ctw(train, texts, depth):
    """Nodes as dictionaries, probabilities by recursion over the tree."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    steps = lambda t: ((t[i - depth : i], (t[i] >> (8 - j)) | 1 << j, t[i] >> (7 - j) & 1) for i in range(depth, len(t)) for j in range(8))
    pad = b"\0" * depth
    for t in train:
        for ctx, pre, bit in steps(pad + t):
            for d in range(depth + 1):
                node = ctx[depth - d :]
                counts[node, pre][bit] += 1
                if d:
                    children[node[1:], pre].add(node)
    g = math.lgamma
    kt = {k: g(a + 0.5) + g(b + 0.5) - g(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    weighted = {}
    for (node, pre) in sorted(counts, key=lambda k: -len(k[0])):
        own = kt[node, pre]
        below = sum(weighted[c, pre] for c in children[node, pre])
        weighted[node, pre] = own if len(node) == depth else np.logaddexp(own, below) - math.log(2)

    def p(ctx, pre, bit):
        found = None
        for d in range(depth, -1, -1):
            k = ctx[depth - d :], pre
            if k in counts:
                e = (counts[k][bit] + 0.5) / (sum(counts[k]) + 1)
                own = math.exp(kt[k] - math.log(2) - weighted[k])
                found = e if found is None else own * e + (1 - own) * found
        return 0.5 if found is None else found

    return [sum(math.log10(p(*s)) for s in steps(pad + t)) for t in texts]


def test_context_trees(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "Then", "on", "nonet", "é", "ion"]) for _ in range(r.randrange(0, 25))) for _ in range(40)] + [None, "", "\n\t x  X", "zzz qqq"]
    rows = context_tree.score_documents(frame(spark, texts), depth=3).collect()
    words = [(t or "").encode().lower().split() for t in texts]
    out = [context_tree.held_out(i) for i in range(len(texts))]
    train = [w for w, o in zip(words, out) if not o]
    counts = collections.Counter(x for w in train for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    scores = plain_ctw([context_tree.spelled(w) for w in train], [context_tree.spelled(w) for w in words], 3)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for row in rows:
        w = words[row["doc_id"]]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (out[row["doc_id"]], len(w) + 1, n)
        assert row["n_known"] == sum(counts[x] > 0 for x in [*w, None])
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in [*w, None]), rel=1e-9)
        assert row["score"] == pytest.approx(scores[row["doc_id"]], rel=1e-4)


def test_context_trees_sum_to_one():
    texts = [b"abab\0", b"abba\0"]
    keys, counts = np.unique(context_tree.strings_of(texts, 2)[0], return_counts=True)
    for ctx in (b"\0\0", b"ab", b"qq"):
        every = np.array([(ctx[0] << 16) | (ctx[1] << 8) | b for b in range(256)], np.uint64)
        both = np.unique(np.concatenate([keys, every]))
        n = np.zeros(len(both), np.int64)
        n[np.searchsorted(both, keys)] = counts
        deep, top = context_tree.deep_probabilities(both, n, 2)
        ln_p = context_tree.TopNodes([top]).ln_probability(both, deep)
        assert np.exp(ln_p[np.searchsorted(both, every)]).sum() == pytest.approx(1)


def test_context_trees_of_nothing(spark):
    assert context_tree.score_documents(frame(spark, []).limit(0)).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(30) if context_tree.held_out(i)], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], round(r["score"], 6)) for r in context_tree.score_documents(only).collect()} == {(0, 0, round(32 * math.log10(0.5), 6))}


# ---- lines ------------------------------------------------------------------------------------------------------


def test_lines(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood today"
    texts = ["Head line\n" + long + "\n\nown", "head LINE!\n" + long.replace("today", "todav") + "\nother", None, "", "...\n...", "Head line 1\nHEAD: line 1.", "\n"]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == "...\n..."
    assert out[1]["text"].split("\n")[-1] == "other" and 0 in out[1]["_dropped"]
    assert out[5]["text"] == "Head line 1" and out[5]["grp"] == "x"
    again = line_dedup.digest(frame(spark, texts).repartition(3, "text")).collect()
    assert {(r["doc_id"], r["dropped"]) for r in again} == {(i, ",".join(map(str, r["_dropped"] or []))) for i, r in out.items()}
    assert line_dedup.digest(frame(spark, texts).limit(0)).count() == 0
    twice = frame(spark, ["same line here"]).unionByName(frame(spark, ["same line here"]))
    assert [r["n_dropped"] for r in line_dedup.digest(twice).collect()] == [0, 0]


def test_line_links_are_whole(spark):
    """Every two lines within three bits and the edit bound end in one group."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    base = [" ".join(r.sample(words, 30)) for _ in range(6)]
    lines = base + [b[:-k] for b in base for k in (1, 2, 3)] + [b.replace(b.split()[k], "zz", 1) for b in base for k in range(12)]
    got = line_dedup.line_groups(line_dedup._occurrences(frame(spark, lines), "doc_id", "text")).select("first_at.k", "grp").collect()
    place = {x["k"]: x["grp"] for x in got}
    sims = {}
    for i, t in enumerate(lines):
        w = t.split(" ")
        sims[i] = w
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "h1 long, norm string")
    prints = {x["h1"]: x["sim"] & (1 << 64) - 1 for x in line_dedup.fingerprints(df, ["h1"]).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    links = [
        (i, j) for i, j in itertools.combinations(place, 2)
        if bin(prints[i] ^ prints[j]).count("1") <= 3 and edits(lines[i].split(), lines[j].split()) <= math.floor(max(len(lines[i].split()), len(lines[j].split())) * 0.1 + 1e-9)
    ]
    assert links and all(place[i] == place[j] for i, j in links)  # other keys may join more


def test_lines_are_compared_by_letters(spark):
    """One letter of a short line is within the bound; a word in ten that is a third of the letters is not."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(9)]
    typo = [*words[:4], words[4][:-1] + "z", *words[5:]]
    long = "a b c d e f g h i"
    lines = [" ".join(words), " ".join(typo), long + " " + "k" * 9, long + " " + "m" * 9]
    seen = line_dedup._occurrences(frame(spark, lines), "doc_id", "text").cache()
    known = seen.select(F.col("k").alias("id"), "h1", "h2", F.struct("k", "th", "pos").alias("first_at"))
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    assert [tuple(x) for x in line_dedup._verified(pairs, known, seen, 0.9).collect()] == [(0, 1)]


# ---- near duplicates ---------------------------------------------------------------------------------------------


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_classes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(150)).split()
    family = []
    for i in range(40):  # variants of one text, many of them alike and many not
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        family.append((100_000 + i, " ".join(w)))
    odd = [(200_000, None), (200_001, ""), (200_002, "two words"), (200_003, "Two  words"), (None, "no id at all"), (200_004, "two words"), (200_004, "two words")]
    docs = docs.unionByName(spark.createDataFrame(family + odd, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {k: shingles(t) for k, t in texts.items() if k is not None}
    links = [
        (a, b) for a, b in itertools.combinations([k for k in sets if sets[k]], 2)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a] & sets[b]
    ]
    want = groups_of(links, sets)
    got = near_dedup.class_rows(docs, block=15).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert sum(r["kept"] for r in got) == len(set(want.values())) + 1
    kept = near_dedup.keep_one(docs, block=15).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert near_dedup.class_rows(docs.limit(0)).count() == 0


def test_prob_minhash_estimates():
    r = random.Random(9)
    a = {i: r.randrange(1, 4) for i in range(300)}
    b = {i: a.get(i, 2) for i in range(60, 360)}
    doc = np.array([0] * len(a) + [1] * len(b))
    e = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    s = near_dedup.prob_minhash(doc, e, np.array([*a.values(), *b.values()], float), 2, 2000)
    exact = sum(1 / sum(max(a.get(i, 0) / a[d], b.get(i, 0) / b[d]) for i in {*a, *b}) for d in a.keys() & b.keys())
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


# ---- benchmark ---------------------------------------------------------------------------------------------------


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[1].split()
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    del edited[15]
    texts = [
        noise(50) + " " + items[0].upper().replace(" ", ", ") + " " + noise(400), " ".join(edited), noise(200), None, "",
        " ".join(items[2].split()[:6]) + " " + noise(60), " ".join(items[3].split()[:20]) + " " + noise(10),
        *[items[4] + " " + noise(5) for _ in range(30)],
    ]
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate(items)] + [(99, None), (98, " . ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    assert set(found) == {(0, 10), (1, 11), (6, 13), *((7 + i, 14) for i in range(30))}
    assert (found[0, 10]["doc_from"], found[0, 10]["doc_to"], found[0, 10]["cover"]) == (50, 80, 1.0)
    parts = decontaminate.find_leaks(frame(spark, texts), bench, block_seeds=60).collect()
    assert {(r["doc_id"], r["item_id"]) for r in parts} == set(found)
    left = decontaminate.drop_leaks(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5] and left.columns == ["doc_id", "text", "grp"]
    assert decontaminate.find_leaks(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0


def plain_smith_waterman(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    r = random.Random(8)
    for _ in range(60):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(1, 14))], np.uint64) for _ in range(2))
        m, i0, i1, j0, j1 = decontaminate.align(a, b)
        whole = plain_smith_waterman(a, b)
        assert plain_smith_waterman(a[i0:i1], b[j0:j1]) == whole and m >= whole / 2


# ---- repeated strings ---------------------------------------------------------------------------------------------


def test_repeats(spark):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    part, other = noise(900), noise(430)
    texts = [
        noise(300) + part + noise(200), part[100:700] + noise(500), noise(100) + part[:399] + noise(100), None, "", "aaaa" * 150, "xyz" * 200 + noise(50),
        noise(50) + other + noise(50) + other, noise(2000), part, part, noise(380) + part[200:640] + part[300:800],
    ]
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    rows = {}
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        rows[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, texts).repartition(3)).collect()}
    assert got == rows
    assert repeats.remove_repeats(frame(spark, texts).limit(0)).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = workspace.stash(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "bpe_encoding":
            assert docs.columns == before.columns and counts[-1] <= before.count()
    assert counts[0] > 50 and docs.where("not round_trip").count() == 0
    ids = sorted(r["doc_id"] for r in docs.collect())
    assert ids == sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
