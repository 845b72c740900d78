"""Asking the rules: missing companions of change sets, companions of entities, evidence, coverage, the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.scoring import round_conf, wilson_lower
from basketwise.operators.mining import rules_at
from basketwise.sources.baskets import numbered, touching

#: Rules at floor and support that are sent to all tasks; more of them are joined.
FEW_RULES = 10_000


def find_holes(
    rules: DataFrame, change_sets: DataFrame, min_confidence: float | Column = 0.6, min_support: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """change_set_id, hole, trigger, confidence, raw, co, n: expected companions that a change set lacks, best trigger
    of each. Floors compare the unrounded confidence; ties go to the higher unrounded one, then the lesser trigger.

    Rules are cut to floor and support before they join, and worked out once. min_confidence may be a column of change_sets.
    """
    floor = min_confidence if isinstance(min_confidence, Column) else None
    good = rules_at(rules, 0.0 if floor is not None else min_confidence, min_support)
    good = numbered(good, F.desc("confidence"), F.desc("raw"), "trigger", name="_rank")  # of two rules for one hole the lesser rank is better
    if good.count() <= FEW_RULES:
        return _holes_of_sets(good, change_sets, floor, by)
    return _holes_of_inputs(good.drop("_rank"), change_sets, floor, by)


def _holes_of_sets(good: DataFrame, change_sets: DataFrame, floor: Column | None, by: Sequence[str]) -> DataFrame:
    """find_holes with few rules: each change set comes together once, and what its entities expect is made, cut and reduced where it
    lies. Only change sets are shuffled."""
    keys = [*by, "change_set_id"]
    known = good.select(*by, F.col("trigger").alias("entity")).union(good.select(*by, "companion")).distinct().withColumn("_in_rules", F.lit(True))
    told = change_sets.join(F.broadcast(known), [*by, "entity"], "left")  # all rows of a set count for its floor
    present = F.collect_set(F.when(F.col("_in_rules"), F.col("entity"))).alias("_present")
    sets = told.groupBy(*keys).agg(present, *([F.max(floor).alias("_floor")] if floor is not None else []))
    short = good.select(*by, "trigger", "companion", F.col("raw").alias("_raw"), "_rank")
    expected = sets.withColumn("trigger", F.explode("_present")).join(F.broadcast(short), [*by, "trigger"])
    missing = expected.where(~F.array_contains("_present", F.col("companion")))
    if floor is not None:
        missing = missing.where(F.col("_raw") >= F.col("_floor"))
    best = missing.groupBy(*keys, "companion").agg(F.min("_rank").alias("_rank"))
    return best.join(F.broadcast(good.drop(*by, "companion")), "_rank").drop("_rank").withColumnRenamed("companion", "hole")


def _holes_of_inputs(good: DataFrame, change_sets: DataFrame, floor: Column | None, by: Sequence[str]) -> DataFrame:
    """find_holes with any number of rules, by joins."""
    inputs = change_sets.select(*by, "change_set_id", "entity").distinct()
    if floor is not None:
        floors = change_sets.select(*by, "change_set_id", floor.alias("_floor")).groupBy(*by, "change_set_id").agg(F.max("_floor").alias("_floor"))
        matched = inputs.join(floors, [*by, "change_set_id"]).withColumnRenamed("entity", "trigger").join(good, [*by, "trigger"])
        matched = matched.where(F.col("raw") >= F.col("_floor")).drop("_floor")
    else:
        matched = inputs.withColumnRenamed("entity", "trigger").join(good, [*by, "trigger"])
    present = inputs.withColumnRenamed("entity", "companion")
    missing = matched.join(present, [*by, "change_set_id", "companion"], "left_anti")
    w = Window.partitionBy(*by, "change_set_id", "companion").orderBy(F.desc("confidence"), F.desc("raw"), "trigger")
    best = missing.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.withColumnRenamed("companion", "hole")


def ordered_holes(holes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """With the rank of each hole in its change set: confidence descending, hole ascending."""
    return holes.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "change_set_id").orderBy(F.desc("confidence"), "hole")))


def top_companions(rules: DataFrame, k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Companions of every entity with their rank: confidence, then co, descending, then name. No floor, no support."""
    w = Window.partitionBy(*by, "trigger").orderBy(F.desc("confidence"), F.desc("co"), "companion")
    ranked = rules.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def companions_of(rules: DataFrame, entity: str, k: int) -> DataFrame:
    """Companions of one entity: a filter and a top-k, no shuffle of the rest."""
    return rules.where(F.col("trigger") == entity).orderBy(F.desc("confidence"), F.desc("co"), "companion").limit(k)


def resolve_examples(df: DataFrame, labels: DataFrame, k: int, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """examples as array<struct<tx_id, label>>: the first k ids with their labels, null where one has none."""
    keys = [*by, *keys]
    cut = df.select(*keys, F.posexplode_outer(F.slice("examples", 1, k)).alias("_i", "tx_id"))
    named = cut.join(labels.select(*by, "tx_id", "label"), [*by, "tx_id"], "left")
    lists = named.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "tx_id", "label")))).alias("_l")
    )
    shown = F.transform("_l", lambda x: F.struct(x["tx_id"].alias("tx_id"), x["label"].alias("label")))
    return df.drop("examples").join(lists.select(*keys, shown.alias("examples")), list(keys))


def explain_pairs(
    counts: DataFrame, pairs: DataFrame, asked: DataFrame, floor: float = 0.6, min_support: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """For asked (a, b): n_a, n_b, co, both confidences (rounded) and whether each direction is a rule; zeros if unseen."""
    n = lambda side: counts.select(*by, F.col("entity").alias(side), F.col("n").alias(f"n_{side}"))
    seen = pairs.select(*by, F.col("entity_a").alias("_x"), F.col("entity_b").alias("_y"), "co", *[c for c in ("examples",) if c in pairs.columns])
    joined = asked.join(n("a"), [*by, "a"], "left").join(n("b"), [*by, "b"], "left").withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    out = joined.join(seen, [*by, "_x", "_y"], "left").drop("_x", "_y").fillna(0, ["n_a", "n_b", "co"])
    ab, ba = wilson_lower("co", "n_a"), wilson_lower("co", "n_b")
    return out.select(
        "*", round_conf(ab).alias("confidence_ab"), round_conf(ba).alias("confidence_ba"),
        ((F.col("n_a") >= min_support) & (ab >= floor)).alias("is_rule_ab"), ((F.col("n_b") >= min_support) & (ba >= floor)).alias("is_rule_ba"),
    )


def changed_alone(tx: DataFrame, asked: DataFrame, scan: int = 200, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """For asked (a, b): of the scan newest transactions with a (whatever their size), the newest k without b."""
    newest = touching(tx, asked.select(*by, F.col("a").alias("entity")), scan, by).withColumnRenamed("entity", "a")
    alone = asked.select(*by, "a", "b").distinct().join(newest, [*by, "a"]).where(~F.array_contains("entities", F.col("b")))
    w = Window.partitionBy(*by, "a", "b").orderBy(F.desc("seq"))
    return alone.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "a", "b", "rank", "seq", "tx_id", "label")


def checked_entities(change_sets: DataFrame, counts: DataFrame, min_support: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Changes so far of each input and whether it can trigger rules."""
    seen = change_sets.select(*by, "change_set_id", "entity").distinct().join(counts, [*by, "entity"], "left").fillna(0, ["n"])
    return seen.select(*by, "change_set_id", "entity", "n", (F.col("n") >= min_support).alias("can_trigger"))


def coverage(change_sets: DataFrame, counts: DataFrame, min_support: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Inputs of each change set, and how many of them are unknown (never seen) or thin (below the support)."""
    return checked_entities(change_sets, counts, min_support, by).groupBy(*by, "change_set_id").agg(
        F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("n") == 0).alias("unknown"),
        F.count_if((F.col("n") > 0) & (F.col("n") < min_support)).alias("thin"),
    )


def with_location(df: DataFrame, locations: DataFrame, column: str = "hole", by: Sequence[str] = ()) -> DataFrame:
    return df.join(locations.select(*by, F.col("entity").alias(column), "location"), [*by, column], "left")


def gate(holes: DataFrame, change_sets: DataFrame, fail_at: float = 0.7, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Per change set: holes, suppressed and whether it fails: an active hole's rounded confidence reaches fail_at.
    strict counts suppressed holes as active. holes may lack the column suppressed."""
    own = holes if "suppressed" in holes.columns else holes.withColumn("suppressed", F.lit(False))
    active = F.lit(True) if strict else ~F.col("suppressed")
    sums = own.groupBy(*by, "change_set_id").agg(
        F.count(F.lit(1)).alias("holes"), F.count_if("suppressed").alias("suppressed"),
        F.bool_or(active & (F.col("confidence") >= fail_at)).alias("failing"),
    )
    every = change_sets.select(*by, "change_set_id").distinct().join(sums, [*by, "change_set_id"], "left")
    return every.fillna(0, ["holes", "suppressed"]).withColumn("failing", F.coalesce("failing", F.lit(False)))
