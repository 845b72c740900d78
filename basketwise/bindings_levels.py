"""Queries over the index as it is stored: levels, streams, damage, and what else had no row, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise import bindings as b
from basketwise.bindings import CUSTNAT, EV3D, query
from basketwise.bindings_upkeep import COUNTED, WIDE, _counted, _labelled
from basketwise.operators import lookup, mining, mutes
from basketwise.sources import baskets, store
from basketwise.sources.scratch import listed, new_path, removed
from basketwise.streaming import incremental

ORDPART = b._tx_sql("SELECT l_orderkey, l_partkey::VARCHAR AS entity FROM lineitem", "l_orderkey::VARCHAR", "l_orderkey")


def ordpart(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("part"))
    return baskets.assemble_transactions(rows, ["l_orderkey"], "part", ["l_orderkey"])


def _grown(spark, tx, shares, vacuumed=False):
    """The path of an index that was updated with the given shares of a history one after the other, and vacuumed each time."""
    path, total = new_path(spark, "index"), tx.count()
    for share in shares:
        incremental.update_index(spark, path, tx.where(F.col("seq") < total * share // 100), WIDE)
        if vacuumed:
            store.vacuum(spark, path, 1, 0)
    return path


@query(
    f"WITH {ORDPART}, n AS (SELECT count(*) AS total FROM tx), cut AS (SELECT touch.*, CASE WHEN seq < total * 90 // 100 THEN 0 WHEN seq < total * 99 // 100 THEN 1 ELSE 2 END AS level FROM touch, n) "
    "SELECT level, 'counts' AS section, count(DISTINCT entity) AS rows FROM cut GROUP BY level UNION ALL "
    "SELECT level, 'pairs', count(*) FROM (SELECT DISTINCT a.level, a.entity, b.entity FROM cut a JOIN cut b ON a.seq = b.seq AND a.entity < b.entity) GROUP BY level UNION ALL "
    "SELECT DISTINCT level, 'heads', 1 FROM cut"
)
def index_levels_ordpart(spark, sf_dir):
    """What each of three updates has written follows what it brought."""
    levels = store.index_levels(spark, _grown(spark, ordpart(spark, sf_dir), (90, 99, 100)))
    return levels.where(F.col("section").isin("counts", "pairs", "heads")).select("level", "section", "rows")


@query(f"WITH {ORDPART} SELECT entity_a, entity_b, co, 1 AS levels, 1 AS folders FROM pairs")
def compacted_index_ordpart(spark, sf_dir):
    """S3: updates of like size become one level, and nothing but that is left after vacuum."""
    path = _grown(spark, ordpart(spark, sf_dir), (40, 60, 80, 100), vacuumed=True)
    levels = store.index_levels(spark, path).select("level").distinct().count()
    pairs = store.read_index(spark, path, WIDE, verify="content").pairs
    return pairs.select("entity_a", "entity_b", "co", F.lit(levels).alias("levels"), F.lit(len(listed(spark, f"{path}/levels"))).alias("folders"))


@query(f"WITH {EV3D} {COUNTED.format(how='reused')}")
def streamed_index_ev3d(spark, sf_dir):
    """A stream, the same one restarted, its last batch delivered again, a second stream, a batch update, and the first stream with
    what the batch update had counted already."""
    tx, path = _labelled(b.ev3d(spark, sf_dir)), new_path(spark, "index")
    total = tx.count()
    part = lambda low, high: tx.where((F.col("seq") >= total * low // 100) & (F.col("seq") < total * high // 100))
    folders, checks = [new_path(spark, "source") for _ in range(2)], [new_path(spark, "checkpoint") for _ in range(2)]

    def run(i, rows):
        rows.repartition(2).write.mode("append").parquet(folders[i])
        source = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(folders[i])
        incremental.stream_index(source, path, WIDE, checks[i]).awaitTermination()

    run(0, part(0, 30))
    run(0, part(30, 50))
    stream = incremental.stream_id(spark, checks[0])
    incremental.count_batch(part(30, 50), store.last_batch(spark, path, stream), stream, path, WIDE)
    run(1, part(50, 70))
    incremental.update_index(spark, path, tx, WIDE)
    run(0, part(70, 100))
    return _counted(*incremental.update_index(spark, path, tx, WIDE))


@query(f"WITH {EV3D} SELECT damage, c.* FROM ({COUNTED.format(how='full')}) c, (VALUES ('pointer'), ('missing'), ('changed'), ('short')) AS d(damage)")
def damaged_index_ev3d(spark, sf_dir):
    """An index with a pointer that can't be read, a section gone, changed rows or fewer rows is built again."""
    tx, out = _labelled(b.ev3d(spark, sf_dir)), None
    for damage in ("pointer", "missing", "changed", "short"):
        path = new_path(spark, "index")
        incremental.update_index(spark, path, tx, WIDE)
        level = f"{path}/levels/{listed(spark, f'{path}/levels')[0][0]}"
        if damage == "pointer":
            spark.createDataFrame([("{ no",)], "value string").write.text(f"{path}/commits/{7:012d}")
        elif damage == "missing":
            removed(spark, f"{level}/pairs")
        else:
            rows = spark.createDataFrame(spark.read.parquet(f"{level}/counts").collect(), "entity string, n long")  # a handful of event types
            rows = rows.withColumn("n", F.col("n") + 1) if damage == "changed" else rows.limit(1)
            rows.coalesce(1).write.mode("overwrite").parquet(f"{level}/counts")
        found = _counted(*incremental.update_index(spark, path, tx, WIDE, verify="content")).withColumn("damage", F.lit(damage))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {ORDPART} SELECT trigger, companion, co, n, confidence FROM rules WHERE n >= 35 AND raw >= 0.005::DOUBLE")
def pruned_rules_ordpart(spark, sf_dir):
    """Rules whose pairs are made of entities that can be in one only."""
    return mining.strong_rules(ordpart(spark, sf_dir), 0.005, 35).select("trigger", "companion", "co", "n", "confidence")


@query(
    f"WITH {CUSTNAT}, {b.MUTES.split(', marked')[0]}, again AS (SELECT a.entity AS trigger, b.entity AS hole, a.n + 7 AS until_, a.n AS n FROM counts a JOIN counts b ON a.entity <> b.entity AND a.entity[1] = b.entity[1]), "
    "whole AS (SELECT * FROM mutes ANTI JOIN again USING (trigger, hole) UNION ALL SELECT * FROM again) "
    "SELECT trigger, hole, until_ AS until_trigger_changes, until_ - n AS remaining FROM whole WHERE hole <> (SELECT max(n_name) FROM nation) AND until_ > n"
)
def mute_lifecycle_custnat(spark, sf_dir):
    """Mutes added (some in place of others), stored, removed, pruned and listed."""
    counts, path = mining.entity_counts(b.custnat(spark, sf_dir)), new_path(spark, "mutes")
    x, y = counts.select(F.col("entity").alias("trigger")), counts.select(F.col("entity").alias("hole"))
    new = x.join(y, (F.col("trigger") != F.col("hole")) & (F.substring("trigger", 1, 1) == F.substring("hole", 1, 1)))
    new = new.select("trigger", "hole", F.lit("2024-02-02").cast("timestamp").alias("created_at"), F.lit("why").alias("note"))
    store.write_ignores(mutes.ignore_add(b._mutes(counts), new, counts, 7), path)
    last = b.table(spark, sf_dir, "nation").agg(F.max("n_name").alias("hole"))
    gone = x.crossJoin(F.broadcast(last))  # one row
    left = mutes.ignore_prune(mutes.ignore_remove(store.read_ignores(spark, path), gone), counts)
    return mutes.mute_status(left, counts).select("trigger", "hole", "until_trigger_changes", "remaining")


@query(f"WITH {CUSTNAT} SELECT trigger, companion, confidence, co FROM rules WHERE trigger = (SELECT min(n_name) FROM nation) ORDER BY confidence DESC, co DESC, companion LIMIT 5")
def companions_of_custnat(spark, sf_dir):
    """Of one entity."""
    first = b.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return lookup.companions_of(b._rules(b.custnat(spark, sf_dir)), first, 5).select("trigger", "companion", "confidence", "co")


@query(
    "WITH x AS (SELECT doc_id, n_chars, sum(n_chars) OVER () AS all_, sum(n_chars) OVER (ORDER BY doc_id DESC) AS run_, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) "
    "SELECT doc_id, n_chars FROM x WHERE all_ <= 100000 OR run_ <= 50000 OR r = 1"
)
def retention_one_log(spark, sf_dir):
    """One log for all."""
    return store.trim_by_size(b.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100_000, 50_000)
