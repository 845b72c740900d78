"""Levels that become one: in rounds, with ids stored once, and nothing left that no commit names."""

import pytest

from basketwise.config import MiningConfig
from basketwise.sources import store
from basketwise.streaming import incremental
from tests.test_levels import content, some_sets
from tests.test_mining import history

CONFIG = MiningConfig(max_examples_per_pair=2)


@pytest.mark.parametrize("rows", [1, 10**6])
def test_levels_become_one(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(store, "ROUND_ROWS", rows, raising=False)
    path, tx = tmp_path / "index", history(spark, some_sets(30))
    for upto in (12, 20, 30):
        index, _ = incremental.update_index(spark, str(path), tx.where(f"seq < {upto}"), CONFIG)
    assert content(index) == content(incremental.build_index(tx, CONFIG))
    commit, _ = store.current_commit(spark, str(path))
    named = {x["folder"] for n in range(3) for x in store._commits(spark, str(path), [n])[0]["levels"]}
    assert len(commit["levels"]) == 1 and {p.name for p in (path / "levels").iterdir()} == named
    stored = spark.read.parquet(str(path / "levels" / commit["levels"][0]["folder"] / "pairs"))
    assert "examples" not in stored.columns and "recent" in stored.columns
