"""Leaks against Smith-Waterman of whole documents, without seeds."""

import random

import numpy as np
import pytest

from basketwise.llm import decontaminate

COVER, SIMILARITY, LONG = 0.4, 0.6, 25


def found(items, texts):
    words = decontaminate.Words()
    own = [(i, w, set(w.tolist())) for i, w in enumerate(map(words, items))]
    seeds = decontaminate.all_seeds([x[:2] for x in own], COVER, LONG)
    tables = {s: decontaminate.SeedTable(np.fromiter(of, np.uint64, len(of))) for s, of in seeds.items()}
    return [{r[0] for r in decontaminate.leaks_of(words(t), own, seeds, tables, COVER, SIMILARITY, LONG)} for t in texts]


def whole(item, text):
    words = decontaminate.Words()
    a, b = words(item), words(text)
    m, i0, i1, j0, j1 = decontaminate.align(a, b)
    return m and m / max(i1 - i0, j1 - j0) >= SIMILARITY and (m >= COVER * len(a) or m >= LONG)


def word(r):
    return "".join(r.choice("aeioubcdfg") for _ in range(5))


@pytest.mark.parametrize("n", [500, 1000])
def test_long_items(n):
    r = random.Random(n)
    item = [word(r) for _ in range(n)]
    noise = lambda k: [word(r) for _ in range(k)]
    texts = [" ".join(noise(60) + item[a : a + k] + noise(80)) for a, k in ((10, 25), (130, 30), (n - 50, 50), (200, 24))]
    assert found([" ".join(item)], texts) == [{0}, {0}, {0}, set()]


def test_every_fourth_word_changed():
    r = random.Random(2)
    item = [word(r) for _ in range(40)]
    text = " ".join(word(r) if i % 4 == 3 else w for i, w in enumerate(item))
    assert found([" ".join(item)], [text]) == [{0}]


def test_short_items():
    assert found(["red stone house", "blue", "a b c d e"], ["there is a red stone house here", "so blue it is", "x a b y", "none"]) == [{0}, {1}, {2}, set()]


@pytest.mark.parametrize("changed,least", [(0.1, 1.0), (0.2, 1.0), (0.3, 0.99), (0.4, 0.97)])
def test_edited_copies(changed, least):
    r = random.Random(int(changed * 100))
    hit = of = 0
    for _ in range(300):
        item = [word(r) for _ in range(r.randrange(20, 61))]
        copy = [word(r) if r.random() < changed else w for w in item]
        text = " ".join([*(word(r) for _ in range(30)), *copy, *(word(r) for _ in range(30))])
        if whole(" ".join(item), text):
            of += 1
            hit += found([" ".join(item)], [text]) == [{0}]
    print(changed, hit, of)
    assert of > 50 and hit >= least * of


def test_leak_inside_a_long_alignment():
    """An exact passage that the best alignment stretches over too many other words."""
    r = random.Random(1)
    item = [word(r) for _ in range(60)]
    text = item[:25] + [word(r) for _ in range(24)] + item[25:40] + [word(r) for _ in range(20)] + item[40:]
    assert not whole(" ".join(item), " ".join(text))
    assert found([" ".join(item)], [" ".join(text)]) == [{0}]
