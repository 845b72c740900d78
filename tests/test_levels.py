"""The stored index: levels, streams counted once, damage, many histories, and one hub entity, log or group spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.operators import mining
from basketwise.plans import check
from basketwise.plans.replay import ReplayConfig, block_size, filled_within, positioned, replay, sums_before
from basketwise.sources import baskets, store
from basketwise.sources.running import running_sum
from basketwise.streaming import incremental

TX = "seq long, tx_id string, label string, entities array<string>"
CONFIG = MiningConfig(min_support=2)


def history(spark, sets, first=0):
    return spark.createDataFrame([(first + i, f"t{first + i}", f"label {first + i}", list(s)) for i, s in enumerate(sets)], TX)


def content(index):
    counts = sorted(tuple(r) for r in index.counts.select(*index.by, "entity", "n").collect())
    pairs = sorted((*r[:-1], tuple(r[-1])) for r in index.pairs.select(*index.by, "entity_a", "entity_b", "co", "examples").collect())
    return counts, pairs


def some_sets(n, seed=1, letters="abcdef"):
    r = random.Random(seed)
    return [sorted(r.sample(letters, r.randint(1, 4))) for _ in range(n)]


def run_stream(spark, path, source, checkpoint, by=(), kind=TX):
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.stream_index(stream, path, CONFIG, checkpoint, by).awaitTermination(180)


def test_streams_and_batches_count_once(spark, tmp_path):
    sets = some_sets(24)
    path, folders, checks = str(tmp_path / "index"), [str(tmp_path / f"s{i}") for i in range(2)], [str(tmp_path / f"c{i}") for i in range(2)]
    part = lambda low, high: history(spark, sets[low:high], low)
    whole = lambda n: content(incremental.build_index(part(0, n), CONFIG))
    now = lambda: content(store.read_index(spark, path, CONFIG))
    part(0, 5).repartition(1).write.mode("append").parquet(folders[0])
    run_stream(spark, path, folders[0], checks[0])
    assert now() == whole(5)
    part(5, 8).repartition(1).write.mode("append").parquet(folders[0])
    run_stream(spark, path, folders[0], checks[0])  # restarted
    assert now() == whole(8)
    first = incremental.stream_id(spark, checks[0])
    last = store.last_batch(spark, path, first)
    assert last == 1 and not incremental.count_batch(part(5, 8), last, first, path, CONFIG)  # delivered again
    assert now() == whole(8)
    part(8, 12).repartition(1).write.parquet(folders[1])
    run_stream(spark, path, folders[1], checks[1])  # a second stream, whose batches begin at 0
    assert now() == whole(12)
    index, how = incremental.update_index(spark, path, part(0, 15), CONFIG)
    assert how == "incremental" and content(index) == whole(15) and index.transactions == 15 and index.head == "t14"
    assert not incremental.count_batch(part(5, 8), last, first, path, CONFIG)  # delivered again after a batch update
    part(12, 18).repartition(1).write.mode("append").parquet(folders[0])  # of these the batch update has counted three
    run_stream(spark, path, folders[0], checks[0])
    index = store.read_index(spark, path, CONFIG)
    assert now() == whole(18) and index.transactions == 18 and index.head == "t17"
    assert store.last_batch(spark, path, first) == 2 and store.last_batch(spark, path, incremental.stream_id(spark, checks[1])) == 0
    assert incremental.update_index(spark, path, part(0, 18), CONFIG)[1] == "reused"


def test_late_rows_of_a_stream_still_count(spark, tmp_path):
    """A stream that is behind: what came before the head and that no batch update has seen is counted."""
    path, sets = str(tmp_path / "index"), some_sets(9)
    assert incremental.count_batch(history(spark, sets[4:6], 4), 0, "one", path, CONFIG)
    assert incremental.update_index(spark, path, history(spark, sets[4:8], 4), CONFIG)[1] == "incremental"
    assert incremental.count_batch(history(spark, sets[:4] + sets[6:], 0).withColumn("seq", F.when(F.col("seq") < 4, F.col("seq")).otherwise(F.col("seq") + 2)), 1, "one", path, CONFIG)
    got = store.read_index(spark, path, CONFIG)
    assert got.transactions == 9 and content(got)[0] == content(incremental.build_index(history(spark, sets), CONFIG))[0]


def test_stream_of_groups(spark, tmp_path):
    path, source = str(tmp_path / "index"), str(tmp_path / "s")
    rows = [(g, i, f"{g}/{i}", None, list(s)) for g in ("x", "y") for i, s in enumerate(some_sets(9, seed=ord(g)))]
    tx = spark.createDataFrame(rows, f"g string, {TX}")
    for low, high in ((0, 4), (4, 9)):
        tx.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(1).write.mode("append").parquet(source)
        run_stream(spark, path, source, str(tmp_path / "c"), ["g"], f"g string, {TX}")
    got = store.read_index(spark, path, CONFIG, ["g"])
    assert content(got) == content(incremental.build_index(tx, CONFIG, by=["g"]))
    assert sorted(tuple(r) for r in got.heads.select("g", "head", "transactions").collect()) == [("x", "x/8", 9), ("y", "y/8", 9)]


DAMAGES = ("garbage pointer", "empty pointer", "pointer gone", "section gone", "file gone", "file cut", "rows changed")


@pytest.mark.parametrize("damage", DAMAGES)
def test_damage_means_build_again(spark, tmp_path, damage):
    path, tx = tmp_path / "index", history(spark, some_sets(12))
    incremental.update_index(spark, str(path), tx.where("seq < 9"), CONFIG)
    incremental.update_index(spark, str(path), tx, CONFIG)
    level = sorted((path / "levels").iterdir())[0]
    pointer = next(p for p in (path / "commits" / f"{1:012d}").iterdir() if p.name.startswith("part-"))
    file = next(p for p in (level / "pairs").iterdir() if p.name.startswith("part-") and p.suffix == ".parquet")
    for p in (pointer, file):
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    if damage == "garbage pointer":
        pointer.write_bytes(b"\xff\x00{ no")
    elif damage == "empty pointer":
        pointer.write_bytes(b"")
    elif damage == "pointer gone":
        pointer.unlink()
    elif damage == "section gone":
        store.removed(spark, str(level / "counts"))
    elif damage == "file gone":
        file.unlink()
    elif damage == "file cut":
        file.write_bytes(file.read_bytes()[:-9])
    else:
        data = bytearray(file.read_bytes())
        data[len(data) // 3] ^= 1
        file.write_bytes(bytes(data))
    named = {x["folder"] for x in (store.current_commit(spark, str(path))[0] or {"levels": []})["levels"]}
    hurt = damage in DAMAGES[:3] or level.name in named  # levels that were made one are no longer read
    index, how = incremental.update_index(spark, str(path), tx, CONFIG, verify="content")
    assert how == ("full" if hurt else "reused") and content(index) == content(incremental.build_index(tx, CONFIG))
    assert incremental.update_index(spark, str(path), tx, CONFIG)[1] == "reused"


def test_a_stream_does_not_start_anew_on_damage(spark, tmp_path):
    path = tmp_path / "index"
    incremental.count_batch(history(spark, ["ab"]), 0, "s", str(path), CONFIG)
    pointer = next(p for p in (path / "commits" / f"{0:012d}").iterdir() if p.name.startswith("part-"))
    (pointer.parent / f".{pointer.name}.crc").unlink(missing_ok=True)
    pointer.write_text("{")
    with pytest.raises(ValueError):
        incremental.count_batch(history(spark, ["ab"], 1), 1, "s", str(path), CONFIG)
    with pytest.raises(ValueError):
        incremental.count_batch(history(spark, ["ab"], 1), 1, "s", str(path), MiningConfig(min_support=3))


def test_an_unfinished_commit_was_never_made(spark, tmp_path, monkeypatch):
    path, tx = tmp_path / "index", history(spark, some_sets(10))
    incremental.update_index(spark, str(path), tx.where("seq < 5"), CONFIG)
    (path / "commits" / f"{1:012d}").mkdir()
    with pytest.raises(ValueError, match="another writer"):
        incremental.update_index(spark, str(path), tx, CONFIG)
    monkeypatch.setattr(store, "UNFINISHED", -1)
    assert incremental.update_index(spark, str(path), tx, CONFIG)[1] == "incremental"
    assert store.current_commit(spark, str(path))[0]["number"] == 2


def test_levels_follow_what_is_new_and_vacuum(spark, tmp_path):
    path, letters = str(tmp_path / "index"), [f"e{i:03d}" for i in range(200)]
    sets = some_sets(400, letters=letters)
    tx = history(spark, sets)
    sizes = []
    for n in (360, 370, 372, 400):
        index, _ = incremental.update_index(spark, path, tx.where(F.col("seq") < n), CONFIG)
        levels = {r["level"]: r["rows"] for r in store.index_levels(spark, path).groupBy("level").agg(F.sum("rows").alias("rows")).collect()}
        sizes.append([levels[k] for k in sorted(levels)])
        assert content(index) == content(incremental.build_index(tx.where(F.col("seq") < n), CONFIG))
    assert [len(s) for s in sizes] == [1, 2, 3, 2]  # the last one took the two small ones in
    assert sizes[1][0] == sizes[0][0] and sizes[1][1] < sizes[0][0] / 10 and sizes[2][2] < sizes[1][1]
    assert store.vacuum(spark, path, keep=2, grace_seconds=0) == 1 and store.vacuum(spark, path, keep=1, grace_seconds=3600) == 0
    assert store.vacuum(spark, path, keep=1, grace_seconds=0) == 2
    assert len(store.listed(spark, f"{path}/levels")) == 2 and len(store.listed(spark, f"{path}/commits")) == 1
    assert content(store.read_index(spark, path, CONFIG, verify="content")) == content(incremental.build_index(tx, CONFIG))


def test_groups_are_updated_in_their_own_ways(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda g, n, old="": [(g, i, f"{old}{g}/{i}", f"l{i}", list(s)) for i, s in enumerate(some_sets(12, seed=ord(g))[:n])]
    table = lambda *parts: spark.createDataFrame(sum(parts, []), f"g string, {TX}")
    incremental.update_groups(spark, path, table(rows("a", 12), rows("b", 7), rows("c", 9, "old"), rows("e", 5)), CONFIG, ["g"])
    now = table(rows("a", 12), rows("b", 12), rows("c", 12), rows("d", 12))
    index, how = incremental.update_groups(spark, path, now, CONFIG, ["g"])
    assert {r["g"]: r["how"] for r in how.collect()} == {"a": "reused", "b": "incremental", "c": "full", "d": "full"}
    want = incremental.build_index(now.union(table(rows("e", 5))), CONFIG, by=["g"])  # e was not asked for and stays
    assert content(index) == content(want)
    labels = lambda i: sorted(tuple(r) for r in i.labels.select("g", "tx_id", "label").collect())
    assert set(labels(want)) <= set(labels(index))
    index, how = incremental.update_groups(spark, path, table(rows("c", 5)), CONFIG, ["g"])  # history cut: c is built again, over three levels
    assert [tuple(r) for r in how.collect()] == [("c", "full")]
    assert content(index) == content(incremental.build_index(table(rows("a", 12), rows("b", 12), rows("c", 5), rows("d", 12), rows("e", 5)), CONFIG, by=["g"]))
    sets = spark.createDataFrame([("a", "s", "a"), ("b", "s", "b")], "g string, change_set_id string, entity string")
    holes, gate = check.check_holes(index, sets)
    assert gate.count() == 2 and {r["g"] for r in holes.collect()} <= {"a", "b"}


def test_one_hub_entity_is_spread(spark):
    rows = spark.range(6000).select(F.lit("hub").alias("a"), F.col("id").alias("pos"), (F.col("id") % 3).alias("e"))
    got = sums_before(rows, ["a"], {"e": "n"}, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.where((F.col("n") != F.expr("(pos div 3) * 3 + case pos % 3 when 0 then 0 when 1 then 0 else 1 end"))).count() == 0
        most = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 4500  # of four tasks
    history = spark.range(10_001).select(F.col("id").alias("pos"))
    assert block_size(history) == 100 and block_size(history.limit(0)) == 64


def test_filled_looks_ahead_over_stretches(spark):
    r = random.Random(3)
    holes = [(k, e) for k in range(40) for e in "ab"]
    seen = [(p, r.choice("ab")) for p in sorted(r.sample(range(45), 12))]
    for ahead in (1, 2, 3, 7):
        got = filled_within(spark.createDataFrame(holes, "k long, hole string"), spark.createDataFrame(seen, "pos long, entity string"), ahead).collect()
        assert {(x["k"], x["hole"]): x["filled"] for x in got} == {(k, e): any(k < p <= k + ahead and x == e for p, x in seen) for k, e in holes}


def test_replay_of_groups_is_replay_of_each(spark):
    c = ReplayConfig(holdout=12, lookahead=2, caps=(2, 4), baseline_cap=2, floors=(0.3, 0.5), min_support=3)
    rows = [(g, i, f"{g}{i}", None, list(s)) for g, n in (("x", 40), ("y", 30), ("z", 3)) for i, s in enumerate(some_sets(n, seed=ord(g), letters="abcd"))]
    tx = spark.createDataFrame(rows, f"g string, {TX}")
    got = sorted(tuple(r) for r in replay(tx, c, ["g"]).collect())
    want = sorted((g, *r) for g in "xyz" for r in replay(tx.where(F.col("g") == g).drop("g"), c).collect())
    assert got == want and {r["held"] for r in positioned(tx, 12, ["g"]).collect()} == {12, 1}


def test_running_sums_of_one_group_fill_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "big").otherwise("small").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sum(rows, [F.desc("o")], "v", "s", ["g"])
        assert got.where("g = 'big'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = {}, {}
    for g, o, v in sorted((tuple(r) for r in rows.collect()), key=lambda r: -r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[o] = sums[g]
    assert {r["o"]: r["s"] for r in got.collect()} == want
    alone = running_sum(rows.drop("g"), ["o"], "v", "s")
    assert alone.agg(F.max("s")).first()[0] == sum(sums.values()) and running_sum(rows.limit(0), ["o"], "v", "s", ["g"]).count() == 0


def test_positions_of_one_big_group(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 450, 1).otherwise(2).alias("g"), F.col("id").alias("k"), F.lit("e").alias("e"))
    got = baskets.assemble_transactions(rows, ["k"], "e", ["k"], by=["g"]).collect()
    assert sorted((r["g"], r["seq"], r["tx_id"]) for r in got) == sorted((1 if i < 450 else 2, i if i < 450 else i - 450, str(i)) for i in range(500))


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_strong_rules_are_the_rules(spark, share):
    tx = history(spark, some_sets(80) + [["rare", "a"], ["rare2", "rare3"], ["b"] * 1])
    for floor, support in ((0.2, 10), (0.45, 3), (0.01, 1), (0.3, 40)):
        want = mining.rules_at(mining.directed_rules(mining.pair_counts(tx), mining.entity_counts(tx)), floor, support)
        cut = mining.strong_rules(tx, floor, support, prune_below=share)
        columns = ["trigger", "companion", "co", "n", "confidence"]
        assert sorted(map(tuple, cut.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    counts = mining.entity_counts(tx)
    assert mining.pair_events(mining.hopeful_transactions(tx, counts, 0.3, 40), carry=()).count() < mining.pair_events(tx, carry=()).count()


DOCS = f"{TX}, versions array<struct<entity:string,content:string>>"


def versions_of(sets, seed=2):
    """Transactions with a.json and b.json among letters; each brings its contents, whose keys change at random."""
    r, state, out = random.Random(seed), {}, []
    for i, s in enumerate(sets):
        own = [f"{x}.json" if x in "ab" else x for x in s]
        docs = []
        for e in own:
            if e.endswith(".json"):
                doc = dict(state.get(e, {"k1": 0, "k2": 0, "k3": {"x": 0}}))
                doc[r.choice(["k1", "k2"])] = r.randint(0, 3)
                state[e] = doc
                docs.append((e, __import__("json").dumps(doc) if r.random() > 0.05 else None))
                if docs[-1][1] is None:
                    state.pop(e)
        out.append((i, f"t{i}", None, own, docs))
    return out


def test_streamed_contents_equal_a_batch(spark, tmp_path):
    config = MiningConfig(min_support=4, facet_candidate_floor=0.2)
    rows = versions_of(some_sets(60, seed=8, letters="abcd"))
    tx = spark.createDataFrame(rows, DOCS)
    path = str(tmp_path / "index")
    for number, (low, high) in enumerate(((0, 3), (3, 25), (25, 26), (26, 60))):
        part = tx.where((F.col("seq") >= low) & (F.col("seq") < high))
        assert incremental.count_batch(part, number, "s", path, config)
        assert not incremental.count_batch(part, number, "s", path, config)
    got = store.read_index(spark, path, config)
    versions = tx.select("seq", F.inline("versions"))
    contents = baskets.with_previous(versions, "content")
    # pairs once trained stay trained: the batch form of the same updates
    index = incremental.build_index(tx.where("seq < 3"), config, contents)
    for low, high in ((3, 25), (25, 26), (26, 60)):
        upto = tx.where(F.col("seq") < high)
        index = incremental.extend_index(index, upto, upto.where(F.col("seq") >= low), contents)
    stats = lambda i: sorted(map(tuple, i.facet_stats.select("trigger", "companion", "facet", "n", "co").collect()))
    assert stats(got) == stats(index) and len(stats(got)) > 4
    full = incremental.build_index(tx, config, contents)
    own = full.facet_training.select("trigger", "companion")
    assert sorted(map(tuple, got.facet_stats.join(own, ["trigger", "companion"], "left_semi").select("trigger", "companion", "facet", "n", "co").collect())) == stats(full)
    assert {r["entity"] for r in got.latest.collect()} == {"a.json", "b.json"}


def test_streamed_units_equal_a_batch(spark, tmp_path):
    from basketwise.operators import units

    r, config, rows, versions, state = random.Random(4), MiningConfig(unit_history_window=0), [], [], {}
    for i in range(30):
        files = r.sample(["f.cs", "g.cs", "h.txt"], r.randint(1, 2))
        own = []
        for f in files:
            now = [(f"{f[0]}{k}", str(r.randint(0, 1))) for k in range(r.randint(0, 3))]
            now += now[:1] if r.random() < 0.2 else []
            own += [(f, u, t) for u, t in now] or [(f, None, None)]
            for side, held in (("before", state.get(f)), ("after", now)):
                if held is not None:
                    versions += [(i, f, side, u, t) for u, t in held] or [(i, f, side, None, None)]
            state[f] = now
        rows.append((i, f"t{i}", None, files, own))
    tx = spark.createDataFrame(rows, f"{TX}, units array<struct<entity:string,unit_id:string,text:string>>")
    path = str(tmp_path / "units")
    for number, (low, high) in enumerate(((0, 1), (1, 14), (14, 30))):
        assert incremental.count_batch(tx.where((F.col("seq") >= low) & (F.col("seq") < high)), number, "s", path, config)
    got = store.read_index(spark, path, config)
    table = spark.createDataFrame(versions, "seq long, entity string, side string, unit_id string, text string")
    want = incremental.build_index(units.unit_transactions(tx, table, config), config.for_units())
    assert content(got) == content(want) and len(content(want)[1]) > 3
    seen = mining.entity_locations(units.unit_locations(units.changed_units(table.join(tx.select("seq", F.explode("entities").alias("entity")).distinct(), ["seq", "entity"], "left_semi"))))
    assert {r["entity"]: r["location"] for r in got.locations.collect() if r["entity"] in dict(content(want)[0])} == {r["entity"]: r["location"] for r in seen.collect() if r["entity"] in dict(content(want)[0])}
