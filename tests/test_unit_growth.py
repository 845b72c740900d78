"""Growing a unit index compares the sides of its versions once, whatever is asked of it then."""

from dataclasses import replace

from basketwise.config import MiningConfig
from basketwise.operators import mining, units
from basketwise.sources import store
from basketwise.streaming import incremental
from tests.test_mining import history, rows


def test_sides_are_compared_once(spark):
    tx = history(spark, [["x.cs", "note.txt"]] * 6)
    sides = [(i, f, side, u, f"{side}{i}") for i in range(6) for f in ("x.cs", "note.txt") for side in ("before", "after") for u in (f[0] + "a", f[0] + "b")]
    versions = spark.createDataFrame(sides, "seq long, entity string, side string, unit_id string, text string")
    config = MiningConfig(unit_history_window=0)
    old = incremental.build_index(units.unit_transactions(tx.where("seq < 3"), versions, config), config.for_units())
    delta = incremental.delta_units(replace(old, config=config), tx.where("seq >= 3"), versions)
    for made in (delta.counts, delta.pairs, delta.locations):
        assert "unit_id" not in made._jdf.queryExecution().optimizedPlan().toString()
    grown = incremental.extend_units(replace(old, config=config), tx.where("seq >= 3"), versions)
    assert rows(grown.pairs, "entity_a", "entity_b", "co") == [("xa", "xb", 6)] and rows(grown.counts, "entity", "n") == [("xa", 6), ("xb", 6)]
    assert rows(grown.locations, "entity", "location") == [("na", "note.txt"), ("nb", "note.txt"), ("xa", "x.cs"), ("xb", "x.cs")]
    assert rows(mining.entity_counts(tx), "entity", "n") == [("note.txt", 6), ("x.cs", 6)]


def test_labels_are_pruned_by_the_pairs_that_are_written(spark, tmp_path, monkeypatch):
    read, prune = [], store.prune_labels
    monkeypatch.setattr(store, "prune_labels", lambda labels, pairs, by=(): read.append(pairs.inputFiles()) or prune(labels, pairs, by))
    config = MiningConfig(max_examples_per_pair=1)
    store.write_index(incremental.build_index(history(spark, ["ab", "ab", "c"]), config), str(tmp_path / "index"))
    assert len(read) == 1 and read[0] and all("/pairs/" in f for f in read[0])
    assert rows(store.read_index(spark, str(tmp_path / "index"), config).labels, "tx_id") == [("t2",)]
