"""Keeping an index up to date: what is new is counted on its own and added as a level, in batch or from a stream.

With `by` columns one index keeps many histories. An update decides for each of them by joins whether it is built again, added to
or left alone, and writes one level for all.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions.json_diff import json_changed_facets
from basketwise.functions.scoring import is_structured
from basketwise.operators.facets import backfill_plan, content_diffs, facet_candidates, facet_observations, facet_stats
from basketwise.operators.mining import directed_rules, entity_counts, entity_locations, pairs_with_examples, prune_labels
from basketwise.operators.units import changed_units, unit_locations, unit_transactions
from basketwise.sources.baskets import clean_transactions, drop_merges, history_window, since
from basketwise.sources.scratch import written
from basketwise.sources.store import SECTIONS, Index, append_level, current_commit, last_batch, merge_levels, read_index, vacuum, write_index

LOWEST = -(1 << 63)


def _stretch(after, upto):
    return F.struct(after.cast("long").alias("after"), upto.cast("long").alias("upto"))


def _heads(all_tx: DataFrame, own: DataFrame, by: Sequence[str], counted: bool) -> DataFrame:
    """by.., head, seq, transactions, counted: the newest transaction of each history, how many are counted, and, for batch updates, that all
    are up to there."""
    last = all_tx.groupBy(*by).agg(F.max_by("tx_id", "seq").alias("head"), F.max("seq").cast("long").alias("seq"))
    n = own.groupBy(*by).agg(F.count(F.lit(1)).alias("transactions"))
    both = last.join(n, list(by), "left") if by else last.crossJoin(F.broadcast(n))  # one row
    stretches = F.array(_stretch(F.lit(LOWEST), F.col("seq"))) if counted else F.array().cast("array<struct<after:bigint,upto:bigint>>")
    return both.select(*by, "head", "seq", F.coalesce("transactions", F.lit(0)).cast("long").alias("transactions"), stretches.alias("counted"))


def _single(index: Index) -> Index:
    """With head and transactions as values where there is one history."""
    row = None if index.by else index.heads.first()
    return index if row is None else replace(index, head=row["head"], transactions=row["transactions"])


def build_index(tx: DataFrame, config: MiningConfig, contents: DataFrame | None = None, by: Sequence[str] = (), counted: bool = True) -> Index:
    """Everything counted from the whole history (or its window) of each group. counted: streams must not count these transactions
    again."""
    by = list(by)
    all_tx = history_window(drop_merges(tx), config.history_window, by)
    own = clean_transactions(all_tx, config.max_transaction_size)
    counts, pairs = entity_counts(own, by), pairs_with_examples(own, config.max_examples_per_pair, by)
    rest = {}
    if contents is not None:
        training = facet_candidates(directed_rules(pairs, counts, by), config, by)
        diffs = content_diffs(contents, training, config, by)
        rest = {"facet_training": training, "facet_stats": facet_stats(facet_observations(diffs, training, all_tx, config.max_transaction_size, by), by)}
    every = own.select(*by, "tx_id", "label")
    labels = prune_labels(every, pairs, by)
    heads = _heads(all_tx, own, by, counted)
    return _single(Index.of(tx.sparkSession, counts, pairs, labels, by, heads=heads, config=config, unpruned=(labels, every), **rest))


def merge_counts(stored: DataFrame, delta: DataFrame) -> DataFrame:
    return stored.unionByName(delta).groupBy("entity").agg(F.sum("n").alias("n"))


def merge_pairs(stored: DataFrame, delta: DataFrame, k: int) -> DataFrame:
    """Sums and the k newest examples of both; each side brings at most k of a pair."""
    both = stored.select("entity_a", "entity_b", "co", "recent").unionByName(delta.select("entity_a", "entity_b", "co", "recent"))
    newest = F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, k)
    merged = both.groupBy("entity_a", "entity_b").agg(F.sum("co").alias("co"), newest.alias("recent"))
    return merged.withColumn("examples", F.transform("recent", lambda x: x["tx_id"]))


def delta_index(index: Index, tx: DataFrame, new: DataFrame, contents: DataFrame | None = None, counted: bool = True) -> Index:
    """What the transactions `new` add to index, as a level: tx is the full history (of the groups of new), read only to train pairs
    that newly qualify. The window bounds full builds only: nothing is taken out. A pair once trained stays trained."""
    config, by = index.config, list(index.by)
    own = clean_transactions(drop_merges(new), config.max_transaction_size)
    counts, pairs = entity_counts(own, by), pairs_with_examples(own, config.max_examples_per_pair, by)
    every = own.select(*by, "tx_id", "label")
    labels = prune_labels(every, pairs, by)
    added = _heads(new, own, by, False)
    old = index.heads.select(*by, *[F.col(c).alias(f"_{c}") for c in ("head", "seq", "transactions", "counted")])
    both = added.join(old, by, "left") if by else added.join(F.broadcast(old), F.lit(True), "left")  # one row, or none before the first transaction
    before = F.coalesce("_counted", F.array().cast("array<struct<after:bigint,upto:bigint>>"))
    at = F.coalesce("_seq", F.lit(LOWEST))
    later = F.col("seq") >= at
    tail = F.try_element_at(before, F.lit(-1))
    grown = F.when(tail["upto"] == at, F.concat(F.slice(before, 1, F.size(before) - 1), F.array(_stretch(tail["after"], F.col("seq"))))).otherwise(
        F.concat(before, F.array(_stretch(at, F.col("seq"))))
    )
    heads = both.select(
        *by, F.when(later, F.col("head")).otherwise(F.col("_head")).alias("head"), F.greatest("seq", "_seq").alias("seq"),
        (F.col("transactions") + F.coalesce("_transactions", F.lit(0))).alias("transactions"), (grown if counted else before).alias("counted"),
    )
    heads = heads.where(F.col("head").isNotNull())
    delta = Index.of(tx.sparkSession, counts, pairs, labels, by, heads=heads, config=config, unpruned=(labels, every))
    if contents is None:
        return delta
    total = merge_levels([index, delta])
    candidates = facet_candidates(directed_rules(total.pairs, total.counts, by), config, by)
    again = written(backfill_plan(candidates, index.facet_training, by), "backfill")
    reset = again.select(*by, "trigger").distinct()
    steady = index.facet_training.join(reset, [*by, "trigger"], "left_anti")
    observe = lambda history, training: facet_observations(
        content_diffs(contents, training, config, by), training, history, config.max_transaction_size, by
    )
    stats = facet_stats(observe(drop_merges(new), steady), by).unionByName(facet_stats(observe(drop_merges(tx), again), by))
    return replace(delta, facet_training=again.select(*by, "trigger", "companion"), facet_stats=stats, facet_resets=reset)


def extend_index(index: Index, tx: DataFrame, new: DataFrame, contents: DataFrame | None = None) -> Index:
    """index with the transactions `new` counted in; see delta_index."""
    grown = merge_levels([index, delta_index(index, tx, new, contents)])
    return _single(replace(grown, labels=prune_labels(grown.labels, grown.pairs, index.by), facet_resets=None))


def delta_units(index: Index, new: DataFrame, versions: DataFrame) -> Index:
    """What the transactions `new` add to a unit index, with the locations of the units that they change."""
    by = list(index.by)
    changed = written(changed_units(versions.join(new.select(*by, "seq"), [*by, "seq"], "left_semi"), by), "changed")
    tx = written(unit_transactions(new, versions, replace(index.config, unit_history_window=0), by=by, changed=changed), "unit-transactions")
    config = replace(index.config, max_transaction_size=index.config.unit_max_transaction_size, history_window=0)
    latest = entity_locations(unit_locations(changed, by), by).select(*by, "entity", "location")
    return replace(delta_index(replace(index, config=config), tx, tx), config=index.config, locations=latest)


def extend_units(index: Index, new: DataFrame, versions: DataFrame) -> Index:
    """A unit index (built with a config's for_units() settings from unit_transactions) with the units changed in the
    transactions `new` counted in, and their locations renewed. versions are those of the new transactions at least."""
    grown = merge_levels([index, delta_units(index, new, versions)])
    return _single(replace(grown, labels=prune_labels(grown.labels, grown.pairs, index.by)))


def group_states(tx: DataFrame, heads: DataFrame, by: Sequence[str]) -> DataFrame:
    """by.., how, after of each history in tx: 'full' where it isn't in heads or its head is not in tx any more, 'reused' where nothing
    came after the head, else 'incremental' with what comes after that seq."""
    by = list(by)
    last = tx.groupBy(*by).agg(F.max("seq").alias("last"))
    known = heads.select(*by, F.col("head").alias("tx_id"))
    found = tx.join(known, [*by, "tx_id"]).groupBy(*by).agg(F.max("seq").alias("after"))
    how = F.when(F.col("after").isNull(), "full").when(F.col("last") > F.col("after"), "incremental").otherwise("reused")
    return last.join(found, by, "left").select(*by, how.alias("how"), "after")


def _side_by_side(parts: Sequence[Index]) -> Index:
    """One level of indexes that share no history."""
    tables = {}
    for name in SECTIONS:
        own = [t for p in parts if (t := getattr(p, name)) is not None]
        if own:
            tables[name] = reduce(DataFrame.unionByName, own)
    if all(p.unpruned for p in parts):
        tables["unpruned"] = (tables["labels"], reduce(DataFrame.unionByName, [p.unpruned[1] for p in parts]))
    return replace(parts[0], **tables)


def update_groups(spark: SparkSession, path: str, tx: DataFrame, config: MiningConfig, by: Sequence[str], contents: DataFrame | None = None) -> tuple[Index, DataFrame]:
    """update_index for many histories: (index, by.. and how of each history in tx). All that changes is one level of one commit;
    histories that tx doesn't have stay as they are."""
    by = list(by)
    stored = read_index(spark, path, config, by)
    if stored is None:
        write_index(build_index(tx, config, contents, by), path)
        return read_index(spark, path, config, by), tx.select(*by).distinct().withColumn("how", F.lit("full"))
    states = written(group_states(tx, stored.heads, by), "states")
    some = {r["how"] for r in states.select("how").distinct().collect()}
    own = lambda df, how: df.join(states.where(F.col("how") == how).select(*by), by, "left_semi")
    parts = []
    if "full" in some:
        made = build_index(own(tx, "full"), config, own(contents, "full") if contents is not None else None, by)
        parts.append(replace(made, group_resets=own(stored.heads.select(*by), "full")))
    if "incremental" in some:
        changing = own(tx, "incremental")
        new = changing.join(states, by).where(F.col("seq") > F.col("after")).drop("how", "after")
        parts.append(delta_index(stored, changing, new, own(contents, "incremental") if contents is not None else None))
    if parts:
        append_level(_side_by_side(parts), path)
        stored = read_index(spark, path, config, by)
    return stored, states.select(*by, "how")


def update_index(
    spark: SparkSession, path: str, tx: DataFrame, config: MiningConfig, contents: DataFrame | None = None, verify: str = "files",
    keep: int | None = None,
) -> tuple[Index, str]:
    """The index at path made current: ('full' | 'reused' | 'incremental').

    Full where there is no usable version (none, other training settings, damage) or its head is not in the history any more; reused
    where nothing came after it. An incremental update writes what is new. keep: delete all but so many versions then."""
    stored = read_index(spark, path, config, verify=verify)
    new = None if stored is None else since(tx, stored.head)
    if new is None:
        write_index(build_index(tx, config, contents), path)
        how = "full"
    elif new.isEmpty():
        return stored, "reused"
    else:
        append_level(delta_index(stored, tx, new, contents), path)
        how = "incremental"
    if keep is not None:
        vacuum(spark, path, keep)
    return read_index(spark, path, config), how


def uncounted(batch: DataFrame, index: Index) -> DataFrame:
    """Transactions of a stream that no batch update has counted."""
    by = list(index.by)
    known = index.heads.select(*by, F.col("counted").alias("_counted"))
    own = batch.join(known, by, "left") if by else batch.join(F.broadcast(known), F.lit(True), "left")  # one row, or none before the first transaction
    inside = F.exists(F.coalesce("_counted", F.array().cast("array<struct<after:bigint,upto:bigint>>")), lambda c: (F.col("seq") > c["after"]) & (F.col("seq") <= c["upto"]))
    return own.where(~inside).drop("_counted")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a streaming query, which its checkpoint keeps: the same after a restart, another for a new checkpoint."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def _with_known(versions: DataFrame, latest: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """before and after of versions(by.., seq, entity, content): the version before it in versions, else the last one known."""
    order = Window.partitionBy(*by, "entity").orderBy("seq")
    own = versions.withColumn("before", F.lag("content").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    if latest is not None:
        last = latest.select(*by, "entity", F.col("content").alias("_known"))
        own = own.join(last, [*by, "entity"], "left").withColumn("before", F.when(F.col("_first"), F.col("_known")).otherwise(F.col("before")))
    return own.select(*by, "seq", "entity", "before", F.col("content").alias("after"))


def _latest(versions: DataFrame, by: Sequence[str]) -> DataFrame:
    newest = versions.groupBy(*by, "entity").agg(F.max_by("content", "seq").alias("content"), F.max("seq").cast("long").alias("seq"))
    return newest.select(*by, "entity", "seq", "content")


def delta_contents(index: Index, new: DataFrame) -> Index:
    """delta_index for transactions that bring the contents they leave (column versions, array of entity and content), where no
    history is at hand: the index itself keeps the last version of each structured entity, what changed in each transaction, and the
    entities of those transactions. A pair that newly qualifies is trained from these.

    Versions of one entity come in order. As in delta_index, a pair once trained stays trained."""
    config, by = index.config, list(index.by)
    delta = delta_index(index, new, new, counted=False)
    versions = new.select(*by, "seq", F.inline("versions")).where(is_structured("entity")).select(*by, "seq", "entity", "content")
    pairs = _with_known(versions, index.latest, by)
    facets = json_changed_facets(F.col("before"), F.col("after"), config.facet_max_depth, config.max_facets_per_entity)
    diffs = written(pairs.select(*by, "seq", "entity", facets.alias("facets")).where(F.size("facets") > 0), "diffs")
    own = drop_merges(new).where(F.size("entities").between(1, config.max_transaction_size))
    touched = own.join(diffs.select(*by, "seq").distinct(), [*by, "seq"], "left_semi").select(*by, "seq", "entities")
    delta = replace(delta, latest=_latest(versions, by), diffs=diffs, touched=touched)
    total = merge_levels([index, delta])
    candidates = facet_candidates(directed_rules(total.pairs, total.counts, by), config, by)
    again = written(backfill_plan(candidates, index.facet_training, by), "backfill")
    reset = again.select(*by, "trigger").distinct()
    steady = index.facet_training.join(reset, [*by, "trigger"], "left_anti")
    observe = lambda d, t, training: facet_observations(d, training, t, config.max_transaction_size, by)
    stats = facet_stats(observe(diffs, touched, steady), by).unionByName(facet_stats(observe(total.diffs, total.touched, again), by))
    return replace(delta, facet_training=again.select(*by, "trigger", "companion"), facet_stats=stats, facet_resets=reset)


UNITS = "array<struct<unit_id:string,text:string>>"


def delta_unit_versions(index: Index, new: DataFrame) -> Index:
    """delta_units for transactions that bring the units they leave (column units, array of entity, unit_id and text; unit_id null for
    an entity without any): the sides before come from the last version of each entity, which the index keeps."""
    by = list(index.by)
    each = new.select(*by, "seq", F.inline("units"))
    one = F.struct("unit_id", "text")
    held = each.groupBy(*by, "seq", "entity").agg(F.array_sort(F.collect_list(F.when(F.col("unit_id").isNotNull(), one))).alias("_u"))
    versions = written(held.select(*by, "seq", "entity", F.to_json("_u").alias("content")), "units")
    pairs = _with_known(versions, index.latest, by)

    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("held")) for name in ("before", "after")])
    rows = pairs.select(*by, "seq", "entity", F.inline(sides)).where("held is not null")
    rows = rows.select(*by, "seq", "entity", "side", F.inline_outer(F.from_json("held", UNITS)))
    return replace(delta_units(index, new, rows.select(*by, "seq", "entity", "side", "unit_id", "text")), latest=_latest(versions, by))


def count_batch(batch: DataFrame, number: int, stream: str, path: str, config: MiningConfig, by: Sequence[str] = ()) -> bool:
    """Batch `number` of a stream counted into the index at path, once: False where it was before.

    The ledger of the commit says which batch of which stream came last, so data and ledger change together. Transactions that a
    batch update has counted meanwhile are left out. An index that is damaged or has other settings is an error: a stream has no
    history to build it from. With a column versions the batch feeds facets too (delta_contents); with a column units it is a
    unit index that grows (delta_unit_versions)."""
    spark = batch.sparkSession
    if last_batch(spark, path, stream) >= number:
        return False
    commit, damaged = current_commit(spark, path)
    stored = read_index(spark, path, config, by)
    if stored is None and (commit is not None or damaged):
        raise ValueError(f"the index at {path} is damaged or has other settings: build it with update_index first")
    if batch.isEmpty():
        return False
    base = stored or build_index(batch.limit(0), config, by=by, counted=False)
    own = uncounted(batch, stored) if stored is not None else batch
    if "units" in batch.columns:
        delta = delta_unit_versions(base, own)
    elif "versions" in batch.columns:
        delta = delta_contents(base, own)
    else:
        delta = delta_index(base, own, own, counted=False)
    if stored is None:
        write_index(delta, path, number, stream)
    else:
        append_level(delta, path, {stream: number})
    return True


def stream_index(source: DataFrame, path: str, config: MiningConfig, checkpoint: str, by: Sequence[str] = ()):
    """A streaming query that counts each micro-batch of whole transactions into the index at path, exactly once, however often it
    is restarted or a batch delivered again, and next to batch updates and other streams."""

    def merge(batch: DataFrame, number: int) -> None:
        count_batch(batch, number, stream_id(batch.sparkSession, checkpoint), path, config, by)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
