"""Which keys of a structured trigger predict a companion.

Tables: diffs(seq, entity, facets: array or null where untrackable), training(trigger, companion), facet_stats(trigger, companion, facet, n, co).
A pair in training without statistics is trained but unobserved; one that is not in it was never trained. All of them have the `by`
columns of their history too, where many are kept side by side; groups are never null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions.json_diff import json_changed_facets
from basketwise.functions.scoring import facet_class, is_structured, round_conf, wilson_lower


def facet_candidates(rules: DataFrame, config: MiningConfig, by: Sequence[str] = ()) -> DataFrame:
    """Rules worth training: structured trigger, enough support, unrounded confidence at the candidate floor."""
    good = (F.col("n") >= config.min_support) & (F.col("raw") >= config.facet_candidate_floor)
    return rules.where(is_structured("trigger") & good).select(*by, "trigger", "companion").distinct()


def content_diffs(contents: DataFrame, triggers: DataFrame, config: MiningConfig, by: Sequence[str] = ()) -> DataFrame:
    """Changed facets of each version (seq, entity, before, after), of those triggers only: big contents are cut to the
    candidates before they are parsed."""
    wanted = contents.join(triggers.select(*by, F.col("trigger").alias("entity")).distinct(), [*by, "entity"], "left_semi")
    facets = json_changed_facets(F.col("before"), F.col("after"), config.facet_max_depth, config.max_facets_per_entity)
    return wanted.select(*by, "seq", "entity", facets.alias("facets"))


def facet_observations(diffs: DataFrame, training: DataFrame, tx: DataFrame, cap: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(seq, trigger, companion, facet, together) of each changed facet; oversized transactions and null or empty
    diffs give none. The size is that of the raw list."""
    own = tx.where(F.size("entities").between(1, cap)).select(*by, "seq", "entities")
    known = diffs.where(F.size("facets") > 0).withColumnRenamed("entity", "trigger")
    joined = known.join(own, [*by, "seq"]).where(F.array_contains("entities", F.col("trigger"))).join(training, [*by, "trigger"])
    flag = F.array_contains("entities", F.col("companion"))
    return joined.select(*by, "seq", "trigger", "companion", F.explode("facets").alias("facet"), flag.alias("together"))


def facet_stats(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return observations.groupBy(*by, "trigger", "companion", "facet").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("together").cast("long")).alias("co")
    )


def trained_pairs(df: DataFrame, training: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df(trigger, companion, ..) with whether the pair was trained."""
    return df.join(training.distinct().withColumn("trained", F.lit(True)), [*by, "trigger", "companion"], "left").fillna(False, ["trained"])


def backfill_plan(candidates: DataFrame, training: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs to train again from the full history: all old and new companions of every trigger that gained one."""
    new = candidates.join(training, [*by, "trigger", "companion"], "left_anti").select(*by, "trigger").distinct()
    return candidates.unionByName(training.select(*by, "trigger", "companion")).distinct().join(new, [*by, "trigger"], "left_semi")


def facet_breakdown(stats: DataFrame, config: MiningConfig, by: Sequence[str] = ()) -> DataFrame:
    """Each facet's counts, rounded confidence and class."""
    return stats.select(
        *by, "trigger", "companion", "facet", "n", "co", round_conf(wilson_lower("co", "n")).alias("confidence"),
        facet_class("n", "co", config.facet_floor, config.min_facet_support).alias("class"),
    )


def evaluate_suppression(
    holes: DataFrame, changed: DataFrame, stats: DataFrame, training: DataFrame, config: MiningConfig, by: Sequence[str] = ()
) -> DataFrame:
    """holes(change_set_id, hole, trigger, ..) with suppressed and facets (facet and class; null without a verdict).

    changed(change_set_id, trigger, facets) gives the edit's facets. A hole is suppressed only if the pair was trained
    and every changed facet is known and non-predictive; a missing, null or empty diff leaves it standing.
    """
    keys = [*by, "change_set_id", "hole", "trigger"]
    pair = training.select(*by, "trigger", F.col("companion").alias("hole")).distinct()
    asked = holes.select(*keys).join(pair, [*by, "trigger", "hole"], "left_semi").join(changed, [*by, "change_set_id", "trigger"])
    each = asked.select(*keys, F.explode(F.array_distinct("facets")).alias("facet"))
    known = stats.select(*by, "trigger", F.col("companion").alias("hole"), "facet", "n", "co")
    classed = each.join(known, [*by, "trigger", "hole", "facet"], "left").withColumn(
        "class", facet_class("n", "co", config.facet_floor, config.min_facet_support)
    )
    verdict = classed.groupBy(*keys).agg(
        F.every(F.col("class") == "non_predictive").alias("suppressed"), F.array_sort(F.collect_list(F.struct("facet", "class"))).alias("facets")
    )
    return holes.join(verdict, keys, "left").fillna(False, ["suppressed"])
