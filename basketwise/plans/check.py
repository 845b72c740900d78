"""The composite questions: check change sets, expected companions, one rule explained, statistics, reindexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions.scoring import clamp_floor, edit_kind, is_eligible_source
from basketwise.operators import facets, lookup, mining, mutes, units
from basketwise.sources.store import Index, append_findings

FACET_REASON = "every changed key of the trigger is known not to predict this companion"
COSMETIC_REASON = "the edit changes no unit of the trigger"


def check_holes(
    index: Index, change_sets: DataFrame, ignores: DataFrame | None = None, contents: DataFrame | None = None,
    changed_units: DataFrame | None = None, strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(holes with examples, suppressed and reason; gate per change set).

    change_sets(change_set_id, entity [, min_confidence]); contents(change_set_id, entity, before, after) of the edit;
    changed_units(change_set_id, entity, units) of edited source files. A trained structured trigger is judged by its
    changed keys only, a source file by whether any unit changed; what can't be judged stands. Of an index of many histories all
    tables have its by columns.
    """
    by = list(index.by)
    config, rules = index.config, mining.directed_rules(index.pairs, index.counts, by)
    floor = config.default_min_confidence
    if "min_confidence" in change_sets.columns:
        floor = F.coalesce(clamp_floor("min_confidence"), F.lit(config.default_min_confidence))
    holes = lookup.find_holes(rules, change_sets, floor, config.min_support, by)
    holes = lookup.resolve_examples(holes, index.labels, config.example_count, ["change_set_id", "hole"], by)
    holes = holes.withColumn("suppressed", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    if contents is not None:
        edits = contents.withColumnRenamed("entity", "trigger")
        visible = edits.where(~edit_kind("before", "after", F.lit(1)).isin("unknown", "none"))
        judged = visible.join(holes.select(*by, "trigger").distinct(), [*by, "trigger"], "left_semi")
        diffs = judged.select(*by, "change_set_id", "trigger", facets.json_changed_facets(F.col("before"), F.col("after"), config.facet_max_depth, config.max_facets_per_entity).alias("facets"))
        seen = facets.evaluate_suppression(holes.drop("suppressed"), diffs, index.facet_stats, index.facet_training, config, by)
        holes = seen.drop("facets").withColumn("reason", F.when(F.col("suppressed"), F.lit(FACET_REASON)))
        if changed_units is not None:
            none = changed_units.where(is_eligible_source("entity") & (F.size("units") == 0)).select(*by, "change_set_id", F.col("entity").alias("trigger"))
            cosmetic = none.join(visible.select(*by, "change_set_id", "trigger"), [*by, "change_set_id", "trigger"], "left_semi").distinct().withColumn("_c", F.lit(True))
            holes = holes.join(cosmetic, [*by, "change_set_id", "trigger"], "left")
            holes = holes.withColumn("reason", F.when(~F.col("suppressed") & F.col("_c"), F.lit(COSMETIC_REASON)).otherwise(F.col("reason")))
            holes = holes.withColumn("suppressed", F.col("suppressed") | F.coalesce("_c", F.lit(False))).drop("_c")
    if ignores is not None:
        holes = mutes.apply_ignores(holes, ignores, index.counts, by)
    return holes, lookup.gate(holes, change_sets, config.fail_confidence, strict, by)


def full_check(
    index: Index, change_sets: DataFrame, source: str = "check", at: Column | None = None, unit_index: Index | None = None,
    changed_units: DataFrame | None = None, findings_path: str | None = None, strict: bool = False, **how,
) -> dict[str, DataFrame]:
    """One answer to a check: holes and gate (as check_holes), coverage and entities (what the inputs have been seen),
    unit_holes where a unit index and changed units are given; appended to the findings where a path is given."""
    holes, verdict = check_holes(index, change_sets, changed_units=changed_units, strict=strict, **how)
    out = {
        "holes": holes, "gate": verdict, "coverage": lookup.coverage(change_sets, index.counts, index.config.min_support, index.by),
        "entities": lookup.checked_entities(change_sets, index.counts, index.config.min_support, index.by),
    }
    if unit_index is not None and changed_units is not None:
        out["unit_holes"] = find_unit_holes(unit_index, changed_units)
    if findings_path is not None:
        row = F.struct(*index.by, "change_set_id", "trigger", "hole", "confidence", "suppressed", "reason")
        found = holes.select((F.current_timestamp() if at is None else at).alias("timestamp"), F.lit(source).alias("source"), row.alias("result"))
        append_findings(found, findings_path)
    return out


def find_unit_holes(index: Index, changed: DataFrame) -> DataFrame:
    """Missing units of change sets, with the entity where each was last seen. changed(change_set_id, entity, units)."""
    by = index.by
    inputs = changed.select(*by, "change_set_id", F.explode("units").alias("entity"))
    rules = mining.directed_rules(index.pairs, index.counts, by)
    holes = lookup.find_holes(rules, inputs, index.config.default_min_confidence, index.config.min_support, by)
    return lookup.with_location(holes, index.locations, by=by)


def expected_companions(index: Index, asked: DataFrame, k: int = 10, unit_index: Index | None = None) -> DataFrame:
    """Companions of the asked entities; an entity the unit index knows is answered there, with locations."""
    by = index.by
    own = lambda i: mining.directed_rules(i.pairs, i.counts, by)
    routed = asked.select(*by, "entity").distinct().withColumn("level", F.lit("entity"))
    if unit_index is not None:
        routed = units.route_lookup(asked.select(*by, "entity").distinct(), unit_index.counts, index.counts, by).drop("n")
    answer = lambda i, level: lookup.with_location(
        lookup.top_companions(own(i).join(routed.where(F.col("level") == level).select(*by, F.col("entity").alias("trigger")), [*by, "trigger"], "left_semi"), k, by),
        i.locations, "companion", by,
    ).withColumn("level", F.lit(level))
    out = answer(index, "entity")
    return out if unit_index is None else out.unionByName(answer(unit_index, "unit"), allowMissingColumns=True)


def explain_rule(index: Index, tx: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """pairs (counts, confidences, examples with labels), changed_alone, facets of the asked (a, b)."""
    c, by = index.config, index.by
    pairs = lookup.explain_pairs(index.counts, index.pairs, asked, c.default_min_confidence, c.min_support, by)
    stats = index.facet_stats.join(asked.select(*by, F.col("a").alias("trigger"), F.col("b").alias("companion")).distinct(), [*by, "trigger", "companion"], "left_semi")
    return {
        "pairs": lookup.resolve_examples(pairs, index.labels, c.example_count, ["a", "b"], by),
        "changed_alone": lookup.changed_alone(tx, asked, by=by), "facets": facets.facet_breakdown(stats, c, by),
    }


def stats(index: Index) -> tuple[DataFrame, DataFrame]:
    """(totals, rules at the floors), of all histories together."""
    rules = mining.directed_rules(index.pairs, index.counts, index.by)
    totals = index.counts.agg(F.count(F.lit(1)).alias("entities")).crossJoin(index.pairs.agg(F.count(F.lit(1)).alias("pairs"))).crossJoin(
        index.facet_training.agg(F.countDistinct(*index.by, "trigger").alias("trained_triggers"))
    )  # one row each
    n = totals.withColumn("transactions", F.lit(index.transactions)) if not index.by else totals.crossJoin(index.heads.agg(F.sum("transactions").alias("transactions")))
    return n, mining.rules_at_floors(rules, min_support=index.config.min_support)
