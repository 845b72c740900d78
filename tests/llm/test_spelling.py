"""Spelling variants against brute force: counts, neighbours, forms and roots, filters of any size."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketwise.llm import spelling


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, None, n, len(others), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows_of(seed=4):
    r = random.Random(seed)
    letters = "abÉéÿ÷x"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaa", "aaaaaaab", "x" * 300]

    def edited(w):
        i, kind = r.randrange(len(w)), r.randrange(3)
        return w[:i] + ("" if kind == 0 else r.choice(letters)) + w[i + (kind != 2) :]

    pool = base + [edited(w) for w in base for _ in range(4)]
    pool += [edited(w) for w in pool[25:]]
    weights = [6 ** r.randint(0, 4) for _ in pool]
    rows = [(i, " ".join(r.choices(pool, weights, k=r.randint(0, 120))) + " Über-ALLES 12abcdefg_abcdefg") for i in range(150)]
    rows += [(900, "rootword " * 700 + "rootworde " * 100), (901, "rootwordee, " * 12)]  # a chain of forms
    return rows + [(None, None), (None, "Abcdefg " * 9), (3, ""), (3, "abcdefh " * 3), (3, "abcdefh " * 3)]


@pytest.mark.parametrize("how", [{}, {"filter_bytes": 300, "bits": 8}])
def test_variants_against_brute_force(spark, how, monkeypatch):
    if how:
        monkeypatch.setattr(spelling, "SEGMENT", 2)
    rows = rows_of()
    docs = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, word string").repartition(5)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(docs, **how).collect()}
    want = brute(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] != v[1] for w, v in want.items() if v[0])


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short words only only")], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == [] and spelling.group_variants(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.data())
def test_edits_of_any_word(length, data):
    words = data.draw(st.lists(st.text("aé÷", min_size=length, max_size=length), min_size=1, max_size=6, unique=True))
    vocabulary = {"".join(x) for n in (length - 1, length) for x in ([[]] if n == 0 else __import__("itertools").product("aé÷", repeat=n))}
    blocks = {length: 4, length - 1: 4}
    full = np.full((4, spelling.LANES), 0xFFFFFFFF, np.uint32).tobytes()  # says yes to all
    filters = spelling.Filters(blocks, {(length, 0): full, (length - 1, 0): full})
    alphabet = np.array(sorted(map(ord, "aé÷")), np.uint64)
    got = [(words[i], e) for i, e in spelling.known_edits(words, alphabet, filters)]
    want = {(w, v) for w in words for v in vocabulary if near(w, v) and (len(v) < len(w) or v > w)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_word_is_asked_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "TOGETHER", 50)
    word, other = "ab" * 200, "ab" * 150 + "bb" + "ab" * 49
    key = spelling.spread((spelling.code_points([other]) * spelling.powers(400)[:400]).sum(1, dtype=np.uint64))
    bits = np.zeros((64, spelling.LANES), np.uint32)
    for lane in range(spelling.LANES):
        bits[spelling.block_of(key, 64), lane] |= spelling.lane_bit(key, lane)
    found = [*spelling.known_edits([word], np.array([97, 98], np.uint64), spelling.Filters({400: 64}, {(400, 0): bits.tobytes()}))]
    assert (0, other) in found and len(found) < 20
