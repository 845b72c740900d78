"""Mining one level below the entity: units (members, sections, rows) of entities, from unit_versions(seq, entity, side,
unit_id, text) with side 'before' or 'after'. unit_versions needs a row (unit_id null) for a version that has no unit, so that an
absent side differs from an empty one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions.scoring import is_eligible_source
from basketwise.sources.baskets import clean_transactions, history_window


def _compared(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """changed_units, the units of each version wherever they are."""
    on, is_side = [*by, "seq", "entity"], lambda s: F.coalesce(F.col("side") == s, F.lit(False))
    count = lambda s: F.count(F.when(is_side(s), F.col("text")))
    # equal texts of the sides are counted against each other, so texts are neither gathered nor joined
    texts = units.groupBy(*on, "unit_id", "text").agg(
        count("before").alias("b"), count("after").alias("a"), F.max(is_side("before")).alias("_before"), F.max(is_side("after")).alias("_after")
    )
    same = F.sum(F.abs(F.col("b") - F.col("a"))) == 0
    no_text = (F.sum(F.col("b") + F.col("a")) == 1) & (F.sum(F.when(F.col("text") == "", F.col("b") + F.col("a")).otherwise(0)) == 1)  # none is like an empty one
    sides = lambda f, name: f(F.max("_before"), F.max("_after")).alias(name)
    both = texts.groupBy(*on, "unit_id").agg((same | no_text).alias("same"), sides(lambda b, a: b | a, "seen"), sides(lambda b, a: b & a, "stays"))
    differs = F.col("seen") & ~(F.col("stays") & F.col("same"))
    return both.groupBy(*on).agg(F.array_sort(F.collect_set(F.when(differs, F.col("unit_id")))).alias("units"))


def changed_units(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """seq, entity, units: ids whose text differs between the sides, or that one side lacks. An absent side makes all
    units of the other change; an edit without a changed unit has an empty array. Units with the same id in one version (overloads,
    parts) count as one text, whatever their order."""
    return _compared(units.repartition(*by, "seq", "entity"), by)


def unit_transactions(
    tx: DataFrame, units: DataFrame, config: MiningConfig, only_sources: bool = True, by: Sequence[str] = (), changed: DataFrame | None = None
) -> DataFrame:
    """Transactions whose entities are the units changed in them: newest transactions of the window, those of 1 to cap
    entities by the raw list, eligible entities, their changed units together, 1 to the unit cap of them. changed: changed_units of
    these transactions at least, where they are known."""
    own = config.for_units()
    window = history_window(tx, own.history_window, by).where(F.size("entities").between(1, config.max_transaction_size))
    files = window.select(*by, "seq", F.explode(F.array_distinct("entities")).alias("entity"))
    if only_sources:
        files = files.where(is_eligible_source("entity"))
    on = [*by, "seq", "entity"]
    changed = _compared(units.join(files, on, "left_semi"), by) if changed is None else changed.join(files, on, "left_semi")
    merged = changed.select(*by, "seq", F.explode("units").alias("unit")).groupBy(*by, "seq").agg(F.collect_set("unit").alias("entities"))
    labels = tx.select(*by, "seq", "tx_id", "label")
    return clean_transactions(labels.join(merged, [*by, "seq"]), own.max_transaction_size).drop("n_raw")


def unit_locations(changed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observations (entity = unit, location = its entity, seq, ord) for entity_locations."""
    return changed.select(*by, F.explode("units").alias("unit"), F.col("entity").alias("location"), "seq").select(
        *by, F.col("unit").alias("entity"), "location", "seq", F.col("location").alias("ord")
    )


def route_lookup(asked: DataFrame, unit_counts: DataFrame, entity_counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """asked(entity) with level 'unit' where the unit index knows it, else 'entity', and its count there."""
    u = unit_counts.select(*by, "entity", F.col("n").alias("_u"))
    e = entity_counts.select(*by, "entity", F.col("n").alias("_e"))
    return asked.join(u, [*by, "entity"], "left").join(e, [*by, "entity"], "left").select(
        *asked.columns, F.when(F.col("_u").isNotNull(), "unit").otherwise("entity").alias("level"),
        F.coalesce("_u", "_e", F.lit(0)).alias("n"),
    )
