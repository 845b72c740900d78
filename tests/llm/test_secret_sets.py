"""Sets of linked parts against brute force, and spans of texts with very many matches."""

import random
import time

from basketwise.llm import secrets
from tests.llm.test_secret_links import texts


def sets(spans, scope=300):
    parts = sorted((int(s), secrets.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    groups, last = [], -1
    for s, k, e in parts:
        if last < 0 or s > last + scope:
            groups.append([])
        groups[-1].append((s, k, e))
        last = max(last, e)
    return ",".join(
        f"{i}:{secrets.KINDS[k]}:{s}:{e}" for i, g in enumerate(groups, 1) if len({secrets.SIDES[secrets.KINDS[k]] for _, k, _ in g}) > 1 for s, k, e in g
    )


def test_sets_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = secrets.find_secrets(df).collect()
    assert all(r["links"] == sets(r["spans"]) for r in got) and sum(bool(r["links"]) for r in got) > 50
    assert any("2:" in r["links"] for r in got)


def test_time_follows_the_matches(spark):
    r = random.Random(1)
    text = lambda n: " ".join(f"password = {r.randrange(10**9):012d}" for _ in range(n))
    took = []
    for n in (500, 8_000, 16_000, 64_000):
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string").repartition(1)
        began = time.time()
        assert secrets.find_secrets(df).select("n_assign").first()[0] == n
        took.append(time.time() - began)
    assert took[3] < 8 * max(took[2], 1)
