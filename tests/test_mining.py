"""Counting, rules, holes and their evidence on hand-made histories."""

import math

import pytest
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions import scoring
from basketwise.operators import lookup, mining, mutes
from basketwise.sources import baskets

TX = "seq long, tx_id string, label string, entities array<string>"


def history(spark, sets):
    return spark.createDataFrame([(i, f"t{i + 1}", f"change {i + 1}", list(s)) for i, s in enumerate(sets)], TX)


def rules_of(tx, cap=30):
    own = baskets.clean_transactions(tx, cap)
    return mining.directed_rules(mining.pairs_with_examples(own), mining.entity_counts(own))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def wilson(co, n, z=1.96):
    p = co / n
    return (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


@pytest.mark.parametrize("co,n", [(14, 19), (33, 35), (3, 4), (90, 100), (0, 50)])
def test_wilson(spark, co, n):
    got = spark.range(1).select(scoring.wilson_lower(F.lit(co), F.lit(n))).first()[0]
    assert got == pytest.approx(wilson(co, n), abs=1e-12)


def test_wilson_of_nothing(spark):
    assert spark.range(1).select(scoring.wilson_lower(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_counts_and_pairs(spark):
    tx = history(spark, ["ab", "abc", "a"])
    assert rows(mining.entity_counts(tx), "entity", "n") == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(mining.pair_counts(tx), "entity_a", "entity_b", "co") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_hygiene(spark):
    tx = baskets.clean_transactions(history(spark, ["aab", "abcd", ""]), 3)
    assert rows(tx, "tx_id", "n_raw") == [("t1", 3)]
    assert rows(mining.entity_counts(tx), "entity", "n") == [("a", 1), ("b", 1)]


def test_examples_are_the_newest(spark):
    found = mining.pairs_with_examples(history(spark, ["ab"] * 5), 3).first()
    assert found["co"] == 5 and found["examples"] == ["t5", "t4", "t3"]


def test_labels_are_pruned(spark):
    tx = history(spark, ["ab", "ab"])
    assert rows(mining.prune_labels(tx.select("tx_id", "label"), mining.pairs_with_examples(tx, 1)), "tx_id") == [("t2",)]


@pytest.fixture(scope="module")
def twelve(spark):
    return history(spark, [["a", "b", "c"]] * 6 + [["a", "b"]] * 6 + [["solo", "a"]] + [["solo"]] * 11).cache()


def test_holes(spark, twelve):
    rules = rules_of(twelve)
    sets = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b")], "change_set_id string, entity string")
    found = lookup.find_holes(rules, sets, 0.6).collect()
    assert [(r["change_set_id"], r["hole"], r["trigger"], r["co"], r["n"], r["confidence"]) for r in found] == [("one", "b", "a", 12, 13, 0.6669)]
    assert found[0]["examples"][0] == "t12"
    assert ("one", "c") in rows(lookup.find_holes(rules, sets, 0.2), "change_set_id", "hole")


def test_floor_of_each_change_set(spark, twelve):
    sets = spark.createDataFrame([("low", "a", 0.01), ("none", "a", 0.9)], "change_set_id string, entity string, f double")
    found = lookup.find_holes(rules_of(twelve), sets, scoring.clamp_floor("f"))
    assert rows(found, "change_set_id", "hole") == [("low", "b")]


def test_rule_counts(spark, twelve):
    got = mining.rules_at_floors(rules_of(twelve), (0.1, 0.6, 0.99))
    assert [r["rules"] for r in got.orderBy("floor").collect()] == [4, 2, 0]


def test_companions(spark, twelve):
    got = lookup.top_companions(rules_of(twelve)).where("trigger = 'a'").orderBy("rank").collect()
    assert [r["companion"] for r in got] == ["b", "c", "solo"]


def test_support_is_the_triggers(spark):
    sets = spark.createDataFrame([("s", "x")], "change_set_id string, entity string")
    assert lookup.find_holes(rules_of(history(spark, ["xy"] * 5)), sets, 0.1).count() == 0


def test_explain_unseen(spark, twelve):
    asked = spark.createDataFrame([("a", "b"), ("a", "zzz")], "a string, b string")
    got = {r["b"]: r for r in lookup.explain_pairs(mining.entity_counts(twelve), mining.pair_counts(twelve), asked).collect()}
    assert (got["b"]["co"], got["b"]["n_a"], got["b"]["n_b"], got["b"]["is_rule_ab"]) == (12, 13, 12, True)
    assert (got["zzz"]["co"], got["zzz"]["n_b"], got["zzz"]["confidence_ba"], got["zzz"]["is_rule_ba"]) == (0, 0, 0.0, False)


def test_changed_alone(spark):
    tx = history(spark, ["ab", "a", "ac", "ab"])
    asked = spark.createDataFrame([("a", "b")], "a string, b string")
    assert rows(lookup.changed_alone(tx, asked), "rank", "tx_id") == [(1, "t3"), (2, "t2")]


def test_coverage_and_gate(spark):
    tx = history(spark, ["ab"] * 15 + ["a"])
    sets = spark.createDataFrame([("s", "a"), ("s", "new")], "change_set_id string, entity string")
    assert rows(lookup.coverage(sets, mining.entity_counts(tx)), "inputs", "unknown", "thin") == [(2, 1, 0)]
    holes = lookup.find_holes(rules_of(tx), sets, 0.6)
    assert rows(lookup.gate(holes, sets, 0.7), "holes", "failing") == [(1, True)]
    assert rows(lookup.gate(holes, sets, 0.99), "holes", "failing") == [(1, False)]


def test_mutes(spark):
    tx = history(spark, [["api", "contract"]] * 30 + [["api"]])
    counts, sets = mining.entity_counts(tx), spark.createDataFrame([("s", "api")], "change_set_id string, entity string")
    holes = lookup.find_holes(rules_of(tx), sets, 0.6)
    assert holes.first()["confidence"] == 0.8381
    none = spark.createDataFrame([], "trigger string, hole string, until_trigger_changes long, created_at timestamp, note string")
    new = spark.createDataFrame([("api", "contract", None, "later")], "trigger string, hole string, created_at timestamp, note string")
    made = mutes.ignore_add(none, new, counts, 5)
    muted = mutes.apply_ignores(holes, made, counts).first()
    assert muted["suppressed"] and "5 more" in muted["reason"]
    grown = mining.entity_counts(tx.unionByName(history(spark, [["api"]] * 5)))
    assert not mutes.apply_ignores(holes, made, grown).first()["suppressed"]
    assert mutes.ignore_prune(made, grown).count() == 0 and mutes.ignore_prune(made, counts).count() == 1
    assert mutes.ignore_add(made, new, counts, 7).first()["until_trigger_changes"] == 38
    kept, ignored = mutes.split_ignored(holes, made, counts)
    assert kept.count() == 0 and ignored.count() == 1 and mutes.split_ignored(holes, made, counts, True)[0].count() == 1
    assert lookup.gate(mutes.apply_ignores(holes, made, counts), sets, 0.7, strict=True).first()["failing"]


def test_size_histogram(spark):
    tx = history(spark, ["", "a", "abcdef"])
    got = {r["bucket"]: (r["transactions"], r["share"]) for r in mining.size_histogram(tx, 5).collect()}
    assert got == {"1-5": (1, pytest.approx(1 / 3)), "6-10": (1, pytest.approx(1 / 3))}


def test_groups_stay_apart(spark):
    tx = history(spark, ["ab", "ab", "ac"]).withColumn("repo", F.when(F.col("seq") < 1, "r1").otherwise("r2"))
    assert rows(mining.pair_counts(tx, ["repo"]), "repo", "entity_a", "entity_b", "co") == [("r1", "a", "b", 1), ("r2", "a", "b", 1), ("r2", "a", "c", 1)]


def test_paths(spark):
    cases = {"./x": "x", "././x": "x", "a\\b": "a/b", "/root/p/x": "x", "/root/p2/x": "root/p2/x", "/else": "else"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["n"] for r in df.select("p", scoring.normalize_path("p", F.lit("/root/p")).alias("n")).collect()}
    assert got == cases


def test_names(spark):
    df = spark.createDataFrame([("A.JSON",), ("x.cs",), ("x.g.cs",), ("obj/x.cs",), ("X.Designer.CS",)], "p string")
    got = df.select(scoring.is_structured("p"), scoring.is_eligible_source("p")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False), (False, False)]


def test_commit_log(spark, tmp_path):
    log = "\x01" + "b" * 40 + "\x1fsecond\x1fpart\na.txt\n b.txt \n\n" + "\x01" + "a" * 40 + "\x1ffirst\n\na.txt\n"
    (tmp_path / "log").write_text(log)
    got = baskets.read_commit_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r["seq"], r["tx_id"], r["label"], r["entities"]) for r in got] == [
        (0, "a" * 12, "first", ["a.txt"]), (1, "b" * 12, "second\x1fpart", ["a.txt", "b.txt"]),
    ]


def test_commit_log_of_several_files(spark, tmp_path):
    """Files of 10, 400 and 60 records, cut into many splits, which Spark deals out by size."""
    ids = [f"{i:040d}" for i in range(470)]
    at = 0
    for name, n in (("a", 10), ("b", 400), ("c", 60)):
        (tmp_path / name).write_text("".join(f"\x01{x}\x1fnote {x[-3:]}\n\nfile{x[-1]}.txt\n" for x in ids[at : at + n]))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = baskets.read_commit_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["label"] for r in sorted(got, key=lambda r: r["seq"])] == [f"note {x[-3:]}" for x in ids[::-1]]
    assert sorted(r["seq"] for r in got) == list(range(470))


def test_history_filters(spark):
    tx = history(spark, ["a", "", "b", "ab"])
    assert rows(baskets.history_window(tx, 2), "tx_id") == [("t3",), ("t4",)]
    assert rows(baskets.since(tx, "t3"), "tx_id") == [("t4",)] and baskets.since(tx, "nope") is None
    merged = tx.withColumn("parents", F.when(F.col("seq") == 3, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))))
    assert baskets.drop_merges(merged).count() == 3
    asked = spark.createDataFrame([("a",)], "entity string")
    assert [r["tx_id"] for r in baskets.touching(tx, asked, 0).orderBy("rank").collect()] == ["t4", "t1"]
    old, new = (spark.createDataFrame(x, "entity string, hash string") for x in ([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1"), ("b", "1")]))
    assert rows(baskets.changed_since(old, new), "entity") == [("a",), ("c",)]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        MiningConfig(fail_confidence=1.5)
    with pytest.raises(ValueError):
        MiningConfig(min_support=0)
