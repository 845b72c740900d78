"""Prequential replay as one batch plan: every held-out transaction is checked against the counts just before it, for
all caps at once, and its flags are compared with what the next transactions touch. `by` columns part many histories, each with
a holdout of its own.

Caps are columns, not copies of the rows: an event carries its transaction's size, and each count is a conditional running
sum. State "just before position k" is a sum in two levels: positions are cut into blocks of about the root of their
number, the sums of (key, block) are added up over the blocks before, and a window over events and probes runs inside one block
only. So an entity that is in every transaction is spread over as many tasks as there are blocks. Whether a hole is filled
needs no window: touches are reduced to their first and last place in each stretch of `lookahead` positions, and a hole looks at two
stretches. Rules that can't reach the lowest floor with their final counts are dropped before probes are made: the bound never
exceeds co/n, and counts only grow.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.scoring import round_conf, wilson_lower
from basketwise.operators.mining import pair_events, size_histogram
from basketwise.sources.scratch import written


@dataclass(frozen=True)
class ReplayConfig:
    holdout: int = 2000
    lookahead: int = 10
    max_eval_size: int = 200
    caps: tuple[int, ...] = (20, 30, 50, 75, 100, 200)
    floors: tuple[float, ...] = (0.6, 0.7, 0.8)
    baseline_cap: int = 30
    min_support: int = 10


def positioned(tx: DataFrame, holdout: int, by: Sequence[str] = ()) -> DataFrame:
    """Transactions with pos (0 is the first held-out one of its history, negative before), held (how many are held out), raw and
    distinct sizes."""
    own = F.array_sort(F.array_distinct("entities"))
    totals = tx.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = totals.select(*by, "_n", F.least(F.lit(holdout), F.floor(F.col("_n") / 2)).cast("long").alias("held"))
    whole = tx.join(sized, list(by)) if by else tx.crossJoin(F.broadcast(sized))  # one row
    pos = F.col("seq") - (F.col("_n") - F.col("held"))
    return whole.select(*by, pos.alias("pos"), "held", own.alias("entities"), F.size(own).alias("size"), F.size("entities").alias("n_raw"))


def block_size(history: DataFrame, least: int = 64) -> int:
    """About the root of the range of positions, so that neither blocks nor the places in one are many."""
    low, high = history.agg(F.min("pos"), F.max("pos")).first()
    return max(least, math.isqrt((high or 0) - (low or 0)))


def sums_before(rows: DataFrame, keys: Sequence[str], values: Mapping[str, str], block: int) -> DataFrame:
    """rows with, for each (column, name) of values, name: the sum of column over the rows of the keys with a lower pos."""
    placed = rows.withColumn("_b", F.floor(F.col("pos") / block))
    sums = placed.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_b").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(name) for v, name in values.items()])
    joined = own.join(starts, [*keys, "_b"])
    return joined.select(*rows.columns, *[(F.col(name) + F.col(f"_s_{v}")).alias(name) for v, name in values.items()])


def final_counts(history: DataFrame, caps: Sequence[int], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules with co and n for each cap at the end, entity events, pair events in both directions)."""
    ingested = history.where(F.col("size").between(1, max(caps)))
    touches = ingested.select(*by, "pos", "size", F.explode("entities").alias("a"))
    half = pair_events(ingested, by, ("pos", "size"))
    pairs = half.select(*by, F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), "pos", "size").unionByName(
        half.select(*by, F.col("entity_b").alias("a"), F.col("entity_a").alias("b"), "pos", "size")
    )
    n = touches.groupBy(*by, "a").agg(*[F.count_if(F.col("size") <= c).alias(f"n_{c}") for c in caps])
    co = pairs.groupBy(*by, "a", "b").agg(*[F.count_if(F.col("size") <= c).alias(f"co_{c}") for c in caps])
    return co.join(n, [*by, "a"]), touches, pairs


def rule_state_asof(history: DataFrame, config: ReplayConfig, by: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """by.., k, a, b and, for each cap, n and co of rule a -> b just before k, for every evaluated transaction k with a and
    without b, and every rule that may reach the lowest floor."""
    block = block or block_size(history)
    rules, touches, pairs = final_counts(history, config.caps, by)
    low, least, caps = min(config.floors), config.min_support, config.caps
    hopeful = F.lit(False)
    for c in caps:
        hopeful = hopeful | (F.col(f"co_{c}") >= F.lit(low * least))
    rules = rules.where(hopeful).select(*by, "a", "b")
    probed = history.where((F.col("pos") >= 0) & (F.col("pos") < F.col("held") - config.lookahead) & F.col("n_raw").between(1, config.max_eval_size))
    counted = [(F.col("size") <= c).cast("long").alias(f"e_{c}") for c in caps]
    nothing = [F.lit(0).cast("long").alias(f"e_{c}") for c in caps]
    events = touches.select(*by, "a", "pos", *counted, F.lit(False).alias("probe"))
    asked = probed.select(*by, F.explode("entities").alias("a"), "pos", *nothing, F.lit(True).alias("probe"))
    state_a = sums_before(events.unionByName(asked), [*by, "a"], {f"e_{c}": f"n_{c}" for c in caps}, block).where("probe")
    enough = F.lit(False)
    for c in caps:
        enough = enough | (F.col(f"n_{c}") >= least)
    ready = state_a.where(enough).select(*by, "a", "pos", *[f"n_{c}" for c in caps]).join(rules, [*by, "a"])
    present = probed.select(*by, "pos", F.explode("entities").alias("b"))
    ready = ready.join(present, [*by, "pos", "b"], "left_anti")
    unknown = [F.lit(None).cast("long").alias(f"n_{c}") for c in caps]
    events = pairs.join(rules, [*by, "a", "b"], "left_semi").select(*by, "a", "b", "pos", *counted, *unknown, F.lit(False).alias("probe"))
    asked = ready.select(*by, "a", "b", "pos", *nothing, *[f"n_{c}" for c in caps], F.lit(True).alias("probe"))
    both = written(events.unionByName(asked), "rule-events")  # read twice
    state = sums_before(both, [*by, "a", "b"], {f"e_{c}": f"co_{c}" for c in caps}, block).where("probe")
    return state.select(*by, F.col("pos").alias("k"), "a", "b", *[f"n_{c}" for c in caps], *[f"co_{c}" for c in caps])


def flagged_holes(state: DataFrame, config: ReplayConfig, by: Sequence[str] = ()) -> DataFrame:
    """k, hole and for each cap the rounded confidence of its best trigger; null where none reaches the lowest floor."""
    best = []
    for c in config.caps:
        raw = wilson_lower(f"co_{c}", f"n_{c}")
        ok = (F.col(f"n_{c}") >= config.min_support) & (raw >= min(config.floors))
        best.append(F.max(F.when(ok, round_conf(raw))).alias(f"conf_{c}"))
    some = F.coalesce(*[F.col(f"conf_{c}") for c in config.caps]).isNotNull()
    return state.groupBy(*by, "k", F.col("b").alias("hole")).agg(*best).where(some)


def filled_within(holes: DataFrame, touches: DataFrame, lookahead: int, by: Sequence[str] = ()) -> DataFrame:
    """holes(k, hole, ..) with filled: whether touches(pos, entity) has the hole at k+1 .. k+lookahead.

    Of each entity only the first and last touch in each stretch of lookahead positions are kept. What follows k lies in the
    stretch of k+1, not before k+1, or in the next one, not after k+lookahead."""
    stretch = F.floor(F.col("pos") / lookahead)
    own = touches.select(*by, "entity", stretch.alias("_b"), F.col("pos").alias("_last"), F.lit(None).cast("long").alias("_next"))
    following = touches.select(*by, "entity", (stretch - 1).alias("_b"), F.lit(None).cast("long").alias("_last"), F.col("pos").alias("_next"))
    seen = own.unionByName(following).groupBy(*by, F.col("entity").alias("hole"), "_b").agg(F.max("_last").alias("_last"), F.min("_next").alias("_next"))
    asked = holes.withColumn("_b", F.floor((F.col("k") + 1) / lookahead)).join(seen, [*by, "hole", "_b"], "left")
    filled = (F.col("_last") > F.col("k")) | (F.col("_next") <= F.col("k") + lookahead)
    return asked.select(*holes.columns, F.coalesce(filled, F.lit(False)).alias("filled"))


def replay(tx: DataFrame, config: ReplayConfig = ReplayConfig(), by: Sequence[str] = ()) -> DataFrame:
    """One row for each history, cap and floor: rules (at the end), holes, filled, fill_rate, marginal_holes, marginal_filled,
    marginal_rate; rates are null without holes. Marginal: not flagged at the baseline cap at that place and floor."""
    by = list(by)
    history = written(positioned(tx, config.holdout, by), "replay")
    state = rule_state_asof(history, config, by)
    # appearances count in every held-out transaction, whatever its size
    touches = history.where("pos >= 0").select(*by, "pos", F.explode("entities").alias("entity"))
    holes = filled_within(flagged_holes(state, config, by), touches, config.lookahead, by)
    base = F.col(f"conf_{config.baseline_cap}") if config.baseline_cap in config.caps else F.lit(None).cast("double")
    per_cap = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"conf_{c}").alias("conf")) for c in config.caps])
    floors = F.array(*map(F.lit, config.floors))
    flags = holes.select(*by, "filled", base.alias("base"), F.explode(per_cap).alias("c")).where("c.conf is not null")
    flags = flags.select(*by, "filled", "base", "c.cap", "c.conf", F.explode(floors).alias("floor")).where("conf >= floor")
    marginal = (F.col("cap") != config.baseline_cap) & (F.coalesce(F.col("base"), F.lit(-1.0)) < F.col("floor"))
    cells = flags.groupBy(*by, "cap", "floor").agg(
        F.count(F.lit(1)).alias("holes"), F.count_if("filled").alias("filled"), F.count_if(marginal).alias("marginal_holes"),
        F.count_if(marginal & F.col("filled")).alias("marginal_filled"),
    )
    rules, _, _ = final_counts(history, config.caps, by)
    counts = rules.groupBy(*by).agg(*[
        F.count_if((F.col(f"n_{c}") >= config.min_support) & (wilson_lower(f"co_{c}", f"n_{c}") >= f)).alias(f"r_{c}_{i}")
        for c in config.caps for i, f in enumerate(config.floors)
    ])
    if by:  # histories without any pair
        counts = history.select(*by).distinct().join(counts, by, "left").fillna(0)
    grid = ", ".join(f"{c}, {f}D, r_{c}_{i}" for c in config.caps for i, f in enumerate(config.floors))
    every = counts.select(*by, F.expr(f"stack({len(config.caps) * len(config.floors)}, {grid}) as (cap, floor, rules)"))
    names = ["holes", "filled", "marginal_holes", "marginal_filled"]
    out = every.join(cells if by else F.broadcast(cells), [*by, "cap", "floor"], "left").fillna(0, names)  # without by one row a cell
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        *by, "cap", "floor", "rules", "holes", "filled", rate("filled", "holes").alias("fill_rate"), "marginal_holes",
        "marginal_filled", rate("marginal_filled", "marginal_holes").alias("marginal_rate"),
    )


def replay_coverage(tx: DataFrame, config: ReplayConfig = ReplayConfig(), by: Sequence[str] = ()) -> DataFrame:
    """One row (for each history): evaluated, skipped_large, ingest_only (the last lookahead transactions)."""
    newest = positioned(tx, config.holdout, by).where("pos >= 0")
    evaluated, large = F.col("pos") < F.col("held") - config.lookahead, F.col("n_raw") > config.max_eval_size
    return newest.groupBy(*by).agg(
        F.count_if(evaluated & ~large).alias("evaluated"), F.count_if(evaluated & large).alias("skipped_large"),
        F.count_if(~evaluated).alias("ingest_only"),
    )


def sweep(tx: DataFrame, config: ReplayConfig = ReplayConfig(), path: str | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The whole sweep over caps and floors: cells (also written as CSV where a path is given), coverage of the holdout
    and the histogram of transaction sizes (of all histories together)."""
    cells = replay(tx, config, by)
    if path is not None:
        write_eval(cells, path)
        cells = tx.sparkSession.read.schema(cells.schema).csv(path, header=True)
    return {"cells": cells, "coverage": replay_coverage(tx, config, by), "sizes": size_histogram(tx)}


def write_eval(cells: DataFrame, path: str) -> None:
    """One CSV line a cell, with decimal points."""
    cells.write.mode("overwrite").csv(path, header=True)
