"""JSON differences, facet histories, units, storage, incremental and streaming upkeep, replay against a plain loop."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions.json_diff import diff
from basketwise.operators import facets, lookup, mining, units
from basketwise.plans.check import check_holes, expected_companions, explain_rule, stats
from basketwise.plans.replay import ReplayConfig, replay
from basketwise.sources.store import read_ignores, read_index, trim_by_size, write_ignores, write_index
from basketwise.streaming.incremental import build_index, stream_index, update_index
from tests.test_mining import TX, history, rows, wilson


@pytest.mark.parametrize(
    "before,after,expected",
    [
        ('{\n // note, with "quotes"\n "a": 1, /* x */\n}', '{"a": 2}', ["a"]),
        ('{"a": []}', '{"a": [{}]}', []),
        ('{"a": 1}', '{"a": 1.0}', []),
        ('{"a": true}', '{"a": 1}', ["a"]),
        ('{"a": 1, "a": 2}', '{"a": 2}', []),
        ('{"a": NaN}', '{"a": 1}', None),
        ('{"a": 1, "b": 2}', '{"b": 2, "a": 1}', []),
        ("[" * 70 + "]" * 70, "[]", None),
        ('{"u": "http://x, }"}', '{"u": "http://x, ]",}', ["u"]),
    ],
)
def test_json_diff(before, after, expected):
    assert diff(before, after) == expected


class Paths:
    """Random documents, and the changed paths of two of them by listing every path with what stands there."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def value(self, depth):
        kind = self.r.randrange(6 if depth else 3)
        if kind < 3:
            return [self.r.randrange(3), self.r.choice(["u", "w"]), None][kind]
        if kind == 3:
            return [self.value(depth - 1) for _ in range(self.r.randrange(3))]
        return {k: self.value(depth - 1) for k in self.r.sample(["one", "two", "red"], self.r.randrange(1, 4))}

    def changed(self, x, y, path=(), depth=3):
        """Both sides walked together: what differs in kind or value is one path, cut to its first parts."""
        name = lambda: ".".join(path) or "$"
        if isinstance(x, dict) and isinstance(y, dict) and len(path) < depth:
            out = set()
            for k in {*x, *y}:
                out |= self.changed(x[k], y[k], (*path, k), depth) if k in x and k in y else {".".join((*path, k))}
            return out
        return set() if x == y and type(x) is type(y) else {name()}


def no_arrays(x):
    return {k: no_arrays(v) for k, v in x.items()} if isinstance(x, dict) else "list" if isinstance(x, list) else x


def test_random_documents_against_listed_paths():
    paths = Paths(31)
    for _ in range(400):
        x, y = ({f"k{i}": no_arrays(paths.value(2)) for i in range(3)} for _ in range(2))
        if paths.r.random() < 0.5:
            y = {**x, "k1": y["k1"]}
        assert diff(json.dumps(x), json.dumps(y)) == sorted(paths.changed(x, y)), (x, y)


def test_random_arrays_of_rows():
    r = random.Random(32)
    for _ in range(200):
        rows_ = [{"id": i, "left": r.randrange(2), "right": r.randrange(2)} for i in range(r.randrange(1, 4))]
        other = [{**x, "left": r.randrange(2)} for x in rows_]
        want = ["list[].left"] if any(x["left"] != y["left"] for x, y in zip(rows_, other)) else []
        assert diff(json.dumps({"list": rows_}), json.dumps({"list": other})) == want
    assert diff('{"list": [{"id": 4}]}', '{"list": [{"id": 4}, {"tail": 5}]}') == ["list[].tail"]
    assert diff("7", '"7"') == ["$"] and diff("{", "{}") is None and diff("{}", None) is None


def test_too_many_facets():
    doc = lambda v: "{" + ",".join(f'"k{i}": {v}' for i in range(70)) + "}"
    assert diff(doc(1), doc(2)) is None and len(diff(doc(1), doc(2), max_facets=70)) == 70


def facet_history(spark):
    """14 changes of the stage with plan.md, 6 of the owner, of which the third comes with plan.md, and 10 more of the stage."""
    kinds = ["stage"] * 14 + ["owner"] * 6 + ["stage"] * 10
    sets, contents, doc, last = [], [], {"stage": 0, "owner": 0}, None
    for i, kind in enumerate(kinds):
        doc = {**doc, kind: doc[kind] + 1}
        contents.append((i, "build.json", last, json.dumps(doc)))
        last = json.dumps(doc)
        sets.append(["build.json"] + ["plan.md"] * (kind == "stage" or i == 16))
    return history(spark, sets), spark.createDataFrame(contents, "seq long, entity string, before string, after string")


def test_facets_end_to_end(spark):
    tx, contents = facet_history(spark)
    index = build_index(tx, MiningConfig(), contents)
    got = {r["facet"]: (r["n"], r["co"]) for r in index.facet_stats.where("trigger = 'build.json'").collect()}
    assert got == {"stage": (23, 23), "owner": (6, 1)}  # the first version has none before it
    old = '{"stage": 5, "owner": 5}'
    new = {"owner": '{"stage": 5, "owner": 6}', "stage": '{"stage": 6, "owner": 5}', "both": '{"stage": 6, "owner": 6}', "unseen": '{"stage": 5, "owner": 5, "x": 0}', "same": old}
    sets = spark.createDataFrame([(k, "build.json") for k in new], "change_set_id string, entity string")
    edits = spark.createDataFrame([(k, "build.json", old, v) for k, v in new.items()], "change_set_id string, entity string, before string, after string")
    holes, verdict = check_holes(index, sets, contents=edits)
    assert rows(holes, "change_set_id", "confidence", "suppressed") == sorted((k, round(wilson(25, 30), 4), k == "owner") for k in new)
    assert {r["change_set_id"] for r in verdict.where("holes > suppressed").collect()} == set(new) - {"owner"}
    told = explain_rule(index, tx, spark.createDataFrame([("build.json", "plan.md")], "a string, b string"))
    assert rows(told["facets"], "facet", "class") == [("owner", "non_predictive"), ("stage", "predictive")]
    assert told["pairs"].first()["examples"][0]["label"] == "change 30" and told["changed_alone"].count() == 5


def test_untrained_differs_from_unobserved(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "trigger string, companion string")
    got = facets.trained_pairs(pairs, pairs.where("companion = 'b'"))
    assert rows(got, "companion", "trained") == [("b", True), ("c", False)]


def test_incremental_equals_full(spark, tmp_path):
    tx, contents = facet_history(spark)
    config, path = MiningConfig(), str(tmp_path / "index")
    early = tx.where("seq < 8")
    assert update_index(spark, path, early, config, contents)[1] == "full"
    assert update_index(spark, path, early, config, contents)[1] == "reused"
    index, how = update_index(spark, path, tx, config, contents)
    assert how == "incremental" and index.transactions == 30
    full = build_index(tx, config, contents)
    for name, cols in (("counts", ("entity", "n")), ("pairs", ("entity_a", "entity_b", "co", "examples")), ("labels", ("tx_id", "label")),
                       ("facet_stats", ("facet", "companion", "n", "co")), ("facet_training", ("trigger", "companion"))):
        assert rows(getattr(index, name), *cols) == rows(getattr(full, name), *cols), name
    assert read_index(spark, path, replace(config, max_transaction_size=20)) is None
    assert read_index(spark, path, replace(config, fail_confidence=0.9)) is not None
    assert update_index(spark, path, tx.withColumn("tx_id", F.concat(F.lit("x"), "tx_id")), config, contents)[1] == "full"


def test_stream_equals_batch(spark, tmp_path):
    tx = history(spark, ["ab", "abc", "a", "bc", "ab", "cd"])
    source = str(tmp_path / "in")
    for i in range(3):
        tx.where(F.floor(F.col("seq") / 2) == i).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).json(source)
    config, path = MiningConfig(), str(tmp_path / "index")
    stream_index(stream, path, config, str(tmp_path / "checkpoint")).awaitTermination(120)
    got, full = read_index(spark, path, config), build_index(tx, config)
    assert rows(got.counts, "entity", "n") == rows(full.counts, "entity", "n")
    assert rows(got.pairs, "entity_a", "entity_b", "co", "examples") == rows(full.pairs, "entity_a", "entity_b", "co", "examples")
    # a batch that is delivered again changes nothing
    write_index(got, path, 99)
    assert read_index(spark, path, config).transactions == got.transactions


def test_statistics_and_companions(spark):
    index = build_index(history(spark, ["ab"] * 12), MiningConfig())
    totals, floors = stats(index)
    assert rows(totals, "transactions", "entities", "pairs") == [(12, 2, 1)]
    assert [r["rules"] for r in floors.orderBy("floor").collect()] == [2, 2, 2, 0]
    asked = spark.createDataFrame([("a",), ("zzz",)], "entity string")
    assert rows(expected_companions(index, asked), "trigger", "companion", "level") == [("a", "b", "entity")]


def unit_rows(seq, side, **text):
    return [(seq, "f.cs", side, k, v) for k, v in text.items()]


def test_units(spark):
    schema = "seq long, entity string, side string, unit_id string, text string"
    data = unit_rows(0, "after", M1="a", M2="x")  # created: all units
    data += unit_rows(1, "before", M1="a", M2="x") + unit_rows(1, "after", M1="b", M2="x")
    data += unit_rows(2, "before", M1="b", M2="x") + unit_rows(2, "after", M1="b", M2="x")  # cosmetic
    data += [(3, "f.cs", "before", "O", "1"), (3, "f.cs", "before", "O", "2"), (3, "f.cs", "after", "O", "2"), (3, "f.cs", "after", "O", "1")]
    found = spark.createDataFrame(data, schema)
    assert rows(units.changed_units(found), "seq", "units") == [(0, ["M1", "M2"]), (1, ["M1"]), (2, []), (3, [])]
    tx = history(spark, [["f.cs"]] * 4)
    made = units.unit_transactions(tx, found, MiningConfig())
    assert rows(mining.entity_counts(made), "entity", "n") == [("M1", 2), ("M2", 1)]
    windowed = units.unit_transactions(tx, found, MiningConfig(unit_history_window=3))
    assert rows(mining.entity_counts(windowed), "entity", "n") == [("M1", 1)]


def test_retention(spark):
    log = spark.range(1100).select(F.col("id"), F.lit(1000).alias("size"))
    kept = trim_by_size(log, "id", "size", 1_000_000, 500_000)
    assert kept.agg(F.min("id"), F.max("id"), F.count("id")).first()[:] == (600, 1099, 500)
    assert trim_by_size(log.where("id < 900"), "id", "size", 1_000_000, 500_000).count() == 900
    assert rows(trim_by_size(log.where("id < 3"), "id", "size", 10, 5), "id") == [(2,)]


def test_ignores_survive_bad_lines(spark, tmp_path):
    path = str(tmp_path / "mutes")
    assert read_ignores(spark, path).count() == 0
    write_ignores(spark.createDataFrame([("a", "b", 5, None, None)], "trigger string, hole string, until_trigger_changes long, created_at timestamp, note string"), path)
    (tmp_path / "mutes" / "bad.json").write_text("{ no\n")
    assert rows(read_ignores(spark, path), "trigger", "hole") == [("a", "b")]


def plain_replay(sets, c):
    size = min(c.holdout, len(sets) // 2)
    cut, held = len(sets) - size, sets[len(sets) - size :]
    out = {}
    for cap in c.caps:
        def count(upto):
            n, co = {}, {}
            for s in sets[:upto]:
                if 1 <= len(s) <= cap:
                    for a in s:
                        n[a] = n.get(a, 0) + 1
                        for b in s:
                            if a != b:
                                co[a, b] = co.get((a, b), 0) + 1
            return n, co

        for k in range(size - c.lookahead):
            n, co = count(cut + k)
            best = {}
            for (a, b), m in co.items():
                if a in held[k] and b not in held[k] and n[a] >= c.min_support and (w := wilson(m, n[a])) >= min(c.floors):
                    best[b] = max(best.get(b, 0), round(w, 4))
            out[cap, k] = best
    cells = {}
    for cap in c.caps:
        n, co = {}, {}
        for s in sets:
            if 1 <= len(s) <= cap:
                for a in s:
                    n[a] = n.get(a, 0) + 1
                    for b in s:
                        if a != b:
                            co[a, b] = co.get((a, b), 0) + 1
        for f in c.floors:
            holes = [(k, b) for k in range(size - c.lookahead) for b, w in out[cap, k].items() if w >= f]
            fill = [any(b in x for x in held[k + 1 : k + 1 + c.lookahead]) for k, b in holes]
            new = [cap != c.baseline_cap and out[c.baseline_cap, k].get(b, -1) < f for k, b in holes]
            rules = sum(n[a] >= c.min_support and wilson(m, n[a]) >= f for (a, _), m in co.items())
            cells[cap, f] = (rules, len(holes), sum(fill), sum(new), sum(x and y for x, y in zip(new, fill)))
    return cells


def test_replay_equals_a_loop(spark):
    import random

    r = random.Random(5)
    sets = [sorted({r.choice("abcdef"), *(x for x in "abcd" if r.random() < 0.6)}) if r.random() > 0.05 else [] for _ in range(90)]
    c = ReplayConfig(holdout=30, lookahead=2, caps=(3, 4, 6), baseline_cap=4, floors=(0.3, 0.5, 0.7), min_support=5)
    got = {(x["cap"], x["floor"]): (x["rules"], x["holes"], x["filled"], x["marginal_holes"], x["marginal_filled"]) for x in replay(history(spark, sets), c).collect()}
    assert got == plain_replay(sets, c)


def test_findings_and_eval_files(spark, tmp_path):
    from basketwise.plans.replay import write_eval
    from basketwise.sources.store import append_findings

    found = spark.sql("select timestamp'2024-05-01 10:00:00' as timestamp, 'hook' as source, named_struct('holes', 2, 'failing', true) as result")
    for _ in range(2):
        append_findings(found, str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert rows(log, "source", "day") == [("hook", __import__("datetime").date(2024, 5, 1))] * 2
    cells = replay(history(spark, ["ab", "abc", "b", "ab"] * 6), ReplayConfig(holdout=8, lookahead=1, caps=(2, 3), baseline_cap=2, floors=(0.3,), min_support=3))
    write_eval(cells, str(tmp_path / "eval"))
    back = spark.read.csv(str(tmp_path / "eval"), header=True, inferSchema=True)
    assert rows(back, "cap", "floor") == [(2, 0.3), (3, 0.3)] and back.columns == cells.columns


def test_unit_routing_and_replay_coverage(spark):
    from basketwise.plans.check import find_unit_holes
    from basketwise.plans.replay import replay_coverage
    from basketwise.sources.store import Index

    tx = history(spark, [["u1", "u2"]] * 12 + [["u1"]])
    built = build_index(tx, MiningConfig())
    seen = spark.createDataFrame([("u1", "f.cs"), ("u2", "g.cs")], "entity string, location string")
    index = Index(**{n: getattr(built, n) for n in ("counts", "pairs", "labels", "facet_stats", "facet_training")}, locations=seen)
    changed = spark.createDataFrame([("s", "f.cs", ["u1"])], "change_set_id string, entity string, units array<string>")
    assert rows(find_unit_holes(index, changed), "hole", "trigger", "location") == [("u2", "u1", "g.cs")]
    asked = spark.createDataFrame([("u1",)], "entity string")
    assert rows(expected_companions(index, asked, unit_index=index), "companion", "level") == [("u2", "unit")]
    got = replay_coverage(history(spark, ["ab"] * 20 + ["abcd"] * 10), ReplayConfig(holdout=12, lookahead=3, max_eval_size=3))
    assert rows(got, "evaluated", "skipped_large", "ingest_only") == [(2, 7, 3)]
