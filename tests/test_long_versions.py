"""The version before each one, of entities with more versions than one task should sort."""

import random

import pytest

from basketwise.sources import baskets


@pytest.mark.parametrize("by", [[], ["g"]])
def test_long_histories_have_the_same_versions_before(spark, by):
    r = random.Random(2)
    rows = [(r.choice("xy"), i, r.choice(["a", "a", "a", "b", None]), r.choice([f"v{i}", None])) for i in range(400)]
    versions = spark.createDataFrame(rows, "g string, seq long, entity string, content string").repartition(5)
    told = lambda long: sorted(str(tuple(x)) for x in baskets.with_previous(versions, "content", by, long=long).select("g", "seq", "entity", "before", "after").collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = told(True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(long) == 400 and long == told(False)


def test_no_window_over_an_entity(spark):
    versions = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "seq long, entity string, content string")
    plan = baskets.with_previous(versions, "content", long=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("entity" in line.split("windowspecdefinition(")[1].split(",")[0] for line in plan.splitlines() if "windowspecdefinition(" in line)


def test_empty(spark):
    none = spark.createDataFrame([], "seq long, entity string, content string")
    assert baskets.with_previous(none, "content", long=True).count() == 0
