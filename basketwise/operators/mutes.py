"""Bounded mutes of (trigger, hole), in each history of the `by` columns: in effect until the trigger has changed a given number of times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.functions.scoring import mute_reason

DEFAULT_BUDGET = 30


def mute_status(ignores: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every mute with the changes that remain (0 or less: expired)."""
    n = counts.select(*by, F.col("entity").alias("trigger"), F.col("n").alias("_n"))
    return ignores.join(n, [*by, "trigger"], "left").withColumn("remaining", F.col("until_trigger_changes") - F.coalesce("_n", F.lit(0))).drop("_n")


def active_mutes(ignores: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each muted pair: the first mute made that is in effect."""
    live = mute_status(ignores, counts, by).where("remaining > 0")
    return live.groupBy(*by, "trigger", "hole").agg(F.min_by("remaining", F.struct("created_at", "until_trigger_changes")).alias("remaining"))


def apply_ignores(holes: DataFrame, ignores: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mutes the holes that are not suppressed yet; reason names what remains."""
    own = holes if "suppressed" in holes.columns else holes.withColumn("suppressed", F.lit(False))
    own = own if "reason" in own.columns else own.withColumn("reason", F.lit(None).cast("string"))
    marked = own.join(active_mutes(ignores, counts, by), [*by, "trigger", "hole"], "left")
    mute = ~F.col("suppressed") & F.col("remaining").isNotNull()
    return marked.withColumn("reason", F.when(mute, mute_reason("trigger", "remaining")).otherwise(F.col("reason"))).withColumn(
        "suppressed", F.col("suppressed") | mute
    ).drop("remaining")


def split_ignored(holes: DataFrame, ignores: DataFrame, counts: DataFrame, strict: bool = False, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, ignored) of unit holes; strict keeps all, and still names the ignored."""
    live = active_mutes(ignores, counts, by).select(*by, "trigger", "hole")
    ignored = holes.join(live, [*by, "trigger", "hole"], "left_semi")
    return (holes if strict else holes.join(live, [*by, "trigger", "hole"], "left_anti")), ignored


def ignore_add(ignores: DataFrame, new: DataFrame, counts: DataFrame, budget: int = DEFAULT_BUDGET, by: Sequence[str] = ()) -> DataFrame:
    """With the mutes new(trigger, hole, created_at, note) in place of earlier ones of the same pair."""
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    n = counts.select(*by, F.col("entity").alias("trigger"), F.col("n").alias("_n"))
    made = new.join(n, [*by, "trigger"], "left").select(
        *by, "trigger", "hole", (F.coalesce("_n", F.lit(0)) + budget).cast("long").alias("until_trigger_changes"), "created_at", "note"
    )
    return ignores.join(made, [*by, "trigger", "hole"], "left_anti").select(made.columns).unionByName(made)


def ignore_remove(ignores: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ignores.join(pairs, [*by, "trigger", "hole"], "left_anti")


def ignore_prune(ignores: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Without the expired."""
    return mute_status(ignores, counts, by).where("remaining > 0").drop("remaining")
