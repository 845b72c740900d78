"""Missing companions of many change sets: what is shuffled is the change sets, not what their entities expect."""

import random

import pytest
from pyspark.sql import functions as F

from basketwise.operators import lookup, mining, units
from tests.test_mining import history, rules_of


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(5)
    tx = history(spark, [r.sample("abcdefgh", r.randint(1, 5)) for _ in range(150)]).cache()
    rows = [(r.randrange(2), f"s{r.randrange(40)}", r.choice([*"abcdefgh", "new", None]), r.random() / 2) for _ in range(250)]
    return rules_of(tx), spark.createDataFrame(rows, "g int, change_set_id string, entity string, f double")


@pytest.mark.parametrize("floor", [0.2, 0.9, "f"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_few_and_many_rules_give_the_same_holes(spark, some, monkeypatch, floor, by):
    rules, sets = some
    if by:
        rules = rules.withColumn("g", F.lit(0)).union(rules.where("trigger < 'e'").withColumn("g", F.lit(1)))
    at = F.col("f") if floor == "f" else floor
    found = lambda: sorted(tuple(x) for x in lookup.find_holes(rules, sets, at, 10, by).select(*by, "change_set_id", "hole", "trigger", "confidence", "raw", "co", "n", "examples").collect())
    few = found()
    monkeypatch.setattr(lookup, "FEW_RULES", 0, raising=False)
    assert few == found() and (few or floor == 0.9)


def test_what_sets_expect_is_not_shuffled(spark, some):
    rules, sets = some
    plan = lookup.find_holes(rules, sets, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert not any("companion" in line for line in plan.splitlines() if "hashpartitioning(" in line)


def test_examples_that_nobody_reads_are_not_made(spark):
    tx = history(spark, ["ab", "ab"])
    plan = mining.pairs_with_examples(tx).select("entity_a", "entity_b", "co")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_sides_are_compared_without_a_join(spark):
    rows = [(1, "x.cs", "before", "u", "1"), (1, "x.cs", "after", "u", "2"), (1, "x.cs", "after", None, None), (2, "x.cs", "after", None, None), (3, "x.cs", "before", "u", None), (3, "x.cs", "after", "u", "")]
    found = units.changed_units(spark.createDataFrame(rows, "seq long, entity string, side string, unit_id string, text string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x["seq"], x["units"]) for x in found.collect()) == [(1, ["u"]), (2, []), (3, [])]
