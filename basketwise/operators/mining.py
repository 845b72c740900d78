"""Counts of entities and pairs, evidence, directed rules.

Pairs come from a narrow explode inside each transaction, never from a self-join; all counts combine before their
shuffle, so hub entities and hot pairs cost one row a task. `by` columns part independent histories and are always
followed by the entity in the shuffle key, so one giant history doesn't meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.scoring import round_conf, wilson_lower


def entity_counts(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tx.select(*by, F.explode("entities").alias("entity")).groupBy(*by, "entity").agg(F.count(F.lit(1)).alias("n"))


def pair_events(tx: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ("seq", "tx_id")) -> DataFrame:
    """(entity_a, entity_b) with a < b for every two entities of a transaction; entities must be sorted and distinct."""
    first = tx.select(*by, *carry, "entities", F.posexplode("entities").alias("_i", "entity_a"))
    rest = F.expr("slice(entities, _i + 2, size(entities))")
    return first.select(*by, *carry, "entity_a", F.explode(rest).alias("entity_b"))


def pair_counts(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pair_events(tx, by, ()).groupBy(*by, "entity_a", "entity_b").agg(F.count(F.lit(1)).alias("co"))


def pair_examples(tx: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The newest k transactions of each pair, newest first; a hot pair is cut to k rows a task before it shuffles."""
    w = Window.partitionBy(*by, "entity_a", "entity_b").orderBy(F.desc("seq"))
    newest = pair_events(tx, by).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return newest.groupBy(*by, "entity_a", "entity_b").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "seq", "tx_id"))), lambda x: F.struct(x["seq"].alias("seq"), x["tx_id"].alias("tx_id"))).alias("recent")
    )


def pairs_with_examples(tx: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """entity_a, entity_b, co, recent (seq and id, newest first) and examples (ids)."""
    keys = [*by, "entity_a", "entity_b"]
    both = pair_counts(tx, by).join(pair_examples(tx, k, by), keys, "left")  # so examples that nobody reads aren't made
    return both.withColumn("examples", F.transform("recent", lambda x: x["tx_id"]))


def directed_rules(pairs: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """trigger, companion, co, n, raw (unrounded) and confidence of both directions of each pair."""
    extra = [c for c in ("examples",) if c in pairs.columns]
    there = pairs.select(*by, F.col("entity_a").alias("trigger"), F.col("entity_b").alias("companion"), "co", *extra)
    back = pairs.select(*by, F.col("entity_b").alias("trigger"), F.col("entity_a").alias("companion"), "co", *extra)
    scored = there.unionByName(back).join(counts.withColumnRenamed("entity", "trigger"), [*by, "trigger"])
    return scored.withColumn("raw", wilson_lower("co", "n")).withColumn("confidence", round_conf("raw"))


def rules_at(rules: DataFrame, floor: float, min_support: int = 10) -> DataFrame:
    return rules.where((F.col("n") >= min_support) & (F.col("raw") >= floor))


def hopeful_transactions(tx: DataFrame, counts: DataFrame, floor: float, min_support: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by.., entities, strong): of each transaction the entities that can take part in a rule at floor and min_support, and those of
    them that can be its trigger. A trigger has min_support occurrences; as a rule's bound never exceeds co / n, its companion
    has floor times as many at least."""
    least = max(1, math.ceil(floor * min_support - 1e-9))
    able = counts.where(F.col("n") >= least).select(*by, "entity", (F.col("n") >= min_support).alias("_strong"))
    rows = tx.select(*by, "seq", F.explode("entities").alias("entity")).join(able, [*by, "entity"])
    lists = rows.groupBy(*by, "seq").agg(
        F.array_sort(F.collect_list("entity")).alias("entities"), F.array_sort(F.collect_list(F.when(F.col("_strong"), F.col("entity")))).alias("strong")
    )
    return lists.where((F.size("strong") > 0) & (F.size("entities") > 1))


def strong_rules(tx: DataFrame, floor: float, min_support: int = 10, by: Sequence[str] = (), prune_below: float = 0.8) -> DataFrame:
    """trigger, companion, co, n, raw, confidence of the rules at floor and min_support, for one question whose counts aren't
    stored: the same rows as rules_at(directed_rules(..)).

    Pairs are made of a strong entity and another hopeful one only, where touches of hopeless or weak entities are many
    enough to pay for putting the transactions together again: the share of touches that strong entities have must be under prune_below."""
    counts = entity_counts(tx, by)
    totals = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= min_support, F.col("n"))).alias("strong")).first()
    if not totals["all"] or (totals["strong"] or 0) >= prune_below * totals["all"]:
        return rules_at(directed_rules(pair_counts(tx, by), counts, by), floor, min_support)
    hopeful = hopeful_transactions(tx, counts, floor, min_support, by)
    first = hopeful.select(*by, "entities", F.explode("strong").alias("trigger"))
    pairs = first.select(*by, "trigger", F.explode("entities").alias("companion")).where(F.col("trigger") != F.col("companion"))
    co = pairs.groupBy(*by, "trigger", "companion").agg(F.count(F.lit(1)).alias("co"))
    scored = co.join(counts.where(F.col("n") >= min_support).withColumnRenamed("entity", "trigger"), [*by, "trigger"])
    return scored.withColumn("raw", wilson_lower("co", "n")).withColumn("confidence", round_conf("raw")).where(F.col("raw") >= floor)


def rules_at_floors(rules: DataFrame, floors: Sequence[float] = (0.5, 0.6, 0.7, 0.8), min_support: int = 10) -> DataFrame:
    """Number of rules at each floor, all in one pass."""
    enough = F.col("n") >= min_support
    sums = rules.agg(*[F.count_if(enough & (F.col("raw") >= f)).alias(f"f{i}") for i, f in enumerate(floors)])
    cells = ", ".join(f"{f}D, f{i}" for i, f in enumerate(floors))
    return sums.select(F.expr(f"stack({len(floors)}, {cells}) as (floor, rules)"))


def index_totals(tx: DataFrame, counts: DataFrame, pairs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """One row: transactions, entities, pairs, trained_triggers."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(tx, "transactions").crossJoin(one(counts, "entities")).crossJoin(one(pairs, "pairs"))  # one row each
    if training is None:
        return out.withColumn("trained_triggers", F.lit(0).cast("long"))
    return out.crossJoin(training.agg(F.countDistinct("trigger").alias("trained_triggers")))


#: Upper ends of the size buckets; larger ones share the last.
SIZE_BUCKETS = (5, 10, 20, 30, 50, 75, 100, 200)


def size_histogram(tx: DataFrame, cap: int = 30) -> DataFrame:
    """bucket, transactions, share, over_cap_share. Shares are of all transactions, empty ones included; those fall in
    no bucket. Sizes are those of the raw lists."""
    size = F.size("entities")
    low, bucket = 1, F.when(size < 1, None)
    for high in SIZE_BUCKETS:
        bucket = bucket.when(size <= high, f"{low}-{high}")
        low = high + 1
    sized = tx.select(bucket.otherwise(f">{SIZE_BUCKETS[-1]}").alias("bucket"), size.alias("size"))
    totals = sized.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("size") > cap).alias("_over"))
    return (
        sized.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("transactions")).crossJoin(totals)
        .select("bucket", "transactions", (F.col("transactions") / F.col("_all")).alias("share"), (F.col("_over") / F.col("_all")).alias("over_cap_share"))
    )


def entity_locations(observed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Location last seen of each entity, by (seq, ord)."""
    return observed.groupBy(*by, "entity").agg(F.max_by("location", F.struct("seq", "ord")).alias("location"))


def prune_labels(labels: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels of transactions still cited as examples."""
    return labels.join(pairs.select(*by, F.explode("examples").alias("tx_id")).distinct(), [*by, "tx_id"], "left_semi")
