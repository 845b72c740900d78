"""Tries, copies and the audit of filters against brute force, with awkward rows."""

import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketwise.llm import filter_audit, text_tries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0é", max_size=8), st.integers(0, 9)), max_size=40))
def test_trie_holds_least_ids(rows):
    trie, want = text_tries.Trie(), {}
    ends = [trie.insert(t.encode(), i) for t, i in rows]
    for t, i in rows:
        want[t] = min(want.get(t, i), i)
    assert [e.least for e in ends] == [want[t] for t, _ in rows]
    assert len({id(e) for e in ends}) == len(want)

    def total(node):
        return len(node.label) + sum(total(c) for c in node.children.values())

    assert total(trie.root) <= sum(len(t.encode()) for t in want)


@given(st.binary(max_size=30), st.binary(max_size=30), st.binary(max_size=30))
def test_common_length(head, a, b):
    a, b = head + a, head + b
    n = text_tries.common_length(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def rows_of(seed=3):
    r = random.Random(seed)
    base = [" ".join(r.choice("the of And in it's WORD é x1 $ a|b").split(" ")[0] * r.randint(1, 2) for _ in range(r.randint(0, 400))) for _ in range(60)]
    head = "the same long head of many texts " * 40
    texts = base + [head + str(i) for i in range(60)] + ["", None, " \t\n", "A" * 50_000, "日本 語", head]
    rows = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(400)]
    rows += [(1000 + i, head, "en") for i in range(200)] + [(None, head, "en"), (None, "alone", "fr"), (5, head, "de"), (5, head, "de"), (-3, None, "en")]
    return rows


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    masks = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        masks.append((part or "", "".join(k for k, v in fails.items() if v), labels.get(i, (0, 0))))
    out = {}
    for part in {m[0] for m in masks}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                cell = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
                for p, fails, (good, toxic) in masks:
                    if p != part:
                        continue
                    earlier = any(x in fails for x in order[: step - 1])
                    gone = f in fails and not earlier
                    cell["kept"] += not earlier and not gone
                    cell["removed"] += gone
                    cell["redundant"] += f in fails and earlier
                    cell["unique_fails"] += fails == f
                    cell["good_lost"] += gone and good == 1
                    cell["toxic_lost"] += gone and toxic == 1
                removed_by[f] += cell["removed"]
                out[part, "".join(order), step] = cell
        for (p, order, step), cell in out.items():
            if p == part:
                cell["shapley"] = removed_by[order[step - 1]]
    return out


def test_audit_against_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, mask string, copy boolean").repartition(7)
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 400, 2)}
    table = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1), (399, None, None)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, table, partition_bytes=20_000, grain=500).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({(r[2] or "") for r in rows})
    for r in got:
        assert {k: r[k] for k in want[r["part"], r["filter_order"], r["step"]]} == want[r["part"], r["filter_order"], r["step"]]


@pytest.mark.parametrize("size", [300, 10**9])
def test_flags_are_whole_whatever_the_bounds(spark, size):
    rows = rows_of(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = text_tries.flag_copies(docs, rest=("lang",), partition_bytes=size, grain=100)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=key) == sorted(((i, p, i is not None and least[t or ""] < i) for i, t, p in rows), key=key)
    if size == 300:
        assert len(text_tries.partition_bounds(docs.selectExpr("coalesce(text, '') AS t"), 300, 100)) > 5


def test_a_hot_text_goes_on_once_a_batch(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string").repartition(4)
    sent = docs.selectExpr("doc_id AS _id", "text AS _t").mapInArrow(text_tries._route(spark.sparkContext.broadcast([]), ()), "id long, text binary, copy boolean, dest int")
    assert sent.where("text = cast('hot' AS binary)").count() == 4


def test_no_rows_and_text_keys(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    named = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "name string, text string")
    assert {r[0]: r[1] for r in text_tries.flag_copies(named, key="name").collect()} == {"a": False, "b": True, "c": False}
