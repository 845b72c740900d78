"""Queries over many histories kept side by side, over upkeep in levels and from streams, with their SQL.

Histories: cohort (users by their number, with what each did in three days), region (customers by the region they live in, with
the nations that supply them) and segment (orders by market segment, with their document and the flags of their lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise import bindings as b
from basketwise.bindings import query
from basketwise.config import MiningConfig
from basketwise.functions.scoring import wilson_sql
from basketwise.operators import lookup, mining, mutes
from basketwise.plans import check
from basketwise.plans.replay import ReplayConfig, replay, replay_coverage
from basketwise.sources import baskets, store
from basketwise.sources.scratch import new_path, written
from basketwise.streaming import incremental

WIDE = MiningConfig(max_transaction_size=100)


def _grouped_sql(rows: str, tx_id: str, order: str) -> str:
    """As the SQL of one history, with the group g."""
    return (
        f"raw AS ({rows}), grouped AS (SELECT g, {tx_id} AS tx_id, {order}, list_sort(list(DISTINCT entity)) AS entities FROM raw GROUP BY ALL), "
        f"tx AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS seq, tx_id, entities FROM grouped), "
        "touch AS (SELECT g, seq, tx_id, unnest(entities) AS entity FROM tx), "
        "counts AS (SELECT g, entity, count(*) AS n FROM touch GROUP BY ALL), "
        "events2 AS (SELECT a.g, a.seq, a.tx_id, a.entity AS entity_a, b.entity AS entity_b FROM touch a JOIN touch b ON a.g = b.g AND a.seq = b.seq AND a.entity < b.entity), "
        "pairs AS (SELECT g, entity_a, entity_b, count(*) AS co FROM events2 GROUP BY ALL), "
        "dir2 AS (SELECT g, entity_a AS trigger, entity_b AS companion, co FROM pairs UNION ALL SELECT g, entity_b, entity_a, co FROM pairs), "
        f"rules AS (SELECT d.g, trigger, companion, co, n, {wilson_sql('co', 'n')} AS raw, round_even({wilson_sql('co', 'n')}, 4) AS confidence FROM dir2 d JOIN counts c ON c.g = d.g AND entity = trigger)"
    )


COHORT = _grouped_sql(
    "SELECT user_id % 3 AS g, CAST(floor(epoch(ts) / 259200) AS BIGINT) AS w, user_id, event_type AS entity FROM events", "w || '/' || user_id", "w, user_id"
)
REGION = _grouped_sql(
    "SELECT DISTINCT h.n_regionkey AS g, o_custkey, n.n_name AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation n ON s_nationkey = n.n_nationkey JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey",
    "o_custkey::VARCHAR", "o_custkey",
)
EXAMPLES = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY g, entity_a, entity_b ORDER BY seq DESC) AS r FROM events2), "
    "ex AS (SELECT g, entity_a, entity_b, string_agg(tx_id, ',' ORDER BY r) AS examples FROM ranked WHERE r <= 10 GROUP BY ALL)"
)


def cohort(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = b.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("g"), F.floor(t / 259200).cast("long").alias("w"), "user_id", "event_type")
    return baskets.assemble_transactions(rows, ["w", "user_id"], "event_type", ["w", "user_id"], by=["g"])


def region(spark, sf_dir):
    nation = b.table(spark, sf_dir, "nation")
    home = b.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("g"))
    s = b.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(home, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("g", "o_custkey", "n_name").distinct()
    return baskets.assemble_transactions(rows, ["o_custkey"], "n_name", ["o_custkey"], by=["g"])


def _sets(tx):
    return tx.select("g", F.col("tx_id").alias("change_set_id"), F.explode("entities").alias("entity"))


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


# ---- many histories ---------------------------------------------------------------------------------------------------


@query(f"WITH {COHORT} SELECT g, seq, tx_id, array_to_string(entities, ',') AS entities FROM tx")
def grouped_baskets_cohort(spark, sf_dir):
    """S2 with groups."""
    return cohort(spark, sf_dir).select("g", "seq", "tx_id", _joined("entities"))


def _upkept(spark, sf_dir):
    """An index of the regions that finds one of them missing (0), one up to date (1), one rewritten (3) and two with an older state
    (2, 4), made current in one update; (index, what was done for each)."""
    tx, path = region(spark, sf_dir), new_path(spark, "index")
    half = tx.groupBy("g").agg(F.floor(F.max("seq") / 2).alias("_half"))
    old = tx.where("g > 0").join(half, "g").where((F.col("g") % 2 == 1) | (F.col("seq") <= F.col("_half"))).drop("_half")
    old = old.withColumn("tx_id", F.when(F.col("g") == 3, F.concat(F.lit("old/"), "tx_id")).otherwise(F.col("tx_id")))
    incremental.update_groups(spark, path, old, WIDE, ["g"])
    return incremental.update_groups(spark, path, tx, WIDE, ["g"])


HOW = "CASE g WHEN 1 THEN 'reused' WHEN 0 THEN 'full' WHEN 3 THEN 'full' ELSE 'incremental' END"


@query(
    f"WITH {REGION} SELECT c.g, entity, n, {HOW.replace('g ', 'c.g ', 1)} AS how, (SELECT count(*) FROM tx WHERE tx.g = c.g) AS transactions, (SELECT arg_max(tx_id, seq) FROM tx WHERE tx.g = c.g) AS head FROM counts c"
)
def grouped_upkeep_region(spark, sf_dir):
    """I1, I4, I5 for many histories: full, incremental and reused in one update."""
    index, how = _upkept(spark, sf_dir)
    return index.counts.join(how, "g").join(index.heads, "g").select("g", "entity", "n", "how", "transactions", "head")


@query(f"WITH {REGION}, {EXAMPLES} SELECT g, entity_a, entity_b, co, examples FROM pairs JOIN ex USING (g, entity_a, entity_b)")
def grouped_pairs_region(spark, sf_dir):
    """I1 for many histories: their pairs after that update."""
    return _upkept(spark, sf_dir)[0].pairs.select("g", "entity_a", "entity_b", "co", _joined("examples"))


HOLES = (
    "cand AS (SELECT t.g, t.tx_id AS change_set_id, r.companion AS hole, r.trigger, r.confidence, r.raw FROM touch t JOIN rules r ON r.g = t.g AND r.trigger = t.entity "
    "WHERE r.n >= 10 AND r.raw >= 0.6 AND NOT EXISTS (SELECT 1 FROM touch p WHERE p.g = t.g AND p.seq = t.seq AND p.entity = r.companion)), "
    "holes AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY g, change_set_id, hole ORDER BY confidence DESC, raw DESC, trigger) = 1), "
    "mutes AS (SELECT a.g, a.entity AS trigger, b.entity AS hole, a.n + 1 + a.g AS until_, a.n AS n FROM counts a JOIN counts b ON a.g = b.g AND a.entity < b.entity), "
    "marked AS (SELECT h.*, m.until_ IS NOT NULL AS suppressed, CASE WHEN m.until_ IS NOT NULL THEN 'muted for ' || (m.until_ - m.n) || ' more changes of ' || h.trigger END AS reason "
    "FROM holes h LEFT JOIN mutes m ON m.g = h.g AND m.trigger = h.trigger AND m.hole = h.hole)"
)


def _checked(spark, sf_dir):
    tx = cohort(spark, sf_dir)
    index = incremental.build_index(tx, WIDE, by=["g"])
    first, second = index.counts.select("g", F.col("entity").alias("trigger")), index.counts.select("g", F.col("entity").alias("hole"))
    asked = first.join(second, "g").where("trigger < hole").withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("note", F.lit(None).cast("string"))
    none = asked.limit(0).withColumn("until_trigger_changes", F.lit(0).cast("long"))
    added = mutes.ignore_add(none.select("g", "trigger", "hole", "until_trigger_changes", "created_at", "note"), asked, index.counts, 1, ["g"])
    ignores = added.withColumn("until_trigger_changes", F.col("until_trigger_changes") + F.col("g"))  # each history has budgets of its own
    return check.full_check(index, _sets(tx), ignores=ignores)


@query(f"WITH {COHORT}, {HOLES} SELECT g, change_set_id, hole, trigger, confidence, suppressed, reason FROM marked")
def grouped_check_cohort(spark, sf_dir):
    """E1, J2, J12 for many histories."""
    return _checked(spark, sf_dir)["holes"].select("g", "change_set_id", "hole", "trigger", "confidence", "suppressed", "reason")


@query(
    f"WITH {COHORT}, {HOLES} SELECT s.g, s.change_set_id, count(h.hole) AS holes, count(*) FILTER (WHERE h.suppressed) AS suppressed, "
    "coalesce(bool_or(NOT h.suppressed AND h.confidence >= 0.7), false) AS failing FROM (SELECT DISTINCT g, tx_id AS change_set_id FROM touch) s LEFT JOIN marked h USING (g, change_set_id) GROUP BY ALL"
)
def grouped_gate_cohort(spark, sf_dir):
    """A9 for many histories."""
    return _checked(spark, sf_dir)["gate"]


@query(
    f"WITH {REGION}, sets AS (SELECT n_regionkey AS g, n_name AS entity FROM nation UNION SELECT r_regionkey, r_name FROM region) SELECT g, 's' AS change_set_id, count(*) AS inputs, "
    "count(*) FILTER (WHERE coalesce(n, 0) = 0) AS unknown, count(*) FILTER (WHERE coalesce(n, 0) > 0 AND n < 25) AS thin FROM sets LEFT JOIN counts USING (g, entity) GROUP BY ALL"
)
def grouped_coverage_region(spark, sf_dir):
    """A11, J15 for many histories."""
    n = b.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("entity"))
    sets = n.union(b.table(spark, sf_dir, "region").select("r_regionkey", "r_name")).withColumn("change_set_id", F.lit("s"))
    return lookup.coverage(sets, mining.entity_counts(region(spark, sf_dir), ["g"]), 25, ["g"])


PAIRS = "asked AS (SELECT a.n_regionkey AS g, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name)"


def _asked_pairs(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    x, y = n.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("a")), n.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("b"))
    return x.join(y, "g").where("a <> b")


@query(
    f"WITH {REGION}, {EXAMPLES}, {PAIRS}, shown AS (SELECT g, entity_a, entity_b, string_agg(tx_id, ',' ORDER BY r) AS shown FROM ranked WHERE r <= 3 GROUP BY ALL), "
    "full_ AS (SELECT a.g, a, b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(co, 0) AS co, coalesce(shown, '') AS shown FROM asked a LEFT JOIN counts x ON x.g = a.g AND x.entity = a "
    "LEFT JOIN counts y ON y.g = a.g AND y.entity = b LEFT JOIN pairs p ON p.g = a.g AND p.entity_a = least(a, b) AND p.entity_b = greatest(a, b) "
    "LEFT JOIN shown s ON s.g = a.g AND s.entity_a = least(a, b) AND s.entity_b = greatest(a, b)) "
    f"SELECT g, a, b, n_a, n_b, co, shown, round_even({wilson_sql('co', 'n_a')}, 4) + 0.0 AS confidence_ab FROM full_"
)
def grouped_explained_region(spark, sf_dir):
    """E3, J3, J4 for many histories."""
    tx = region(spark, sf_dir)
    told = check.explain_rule(incremental.build_index(tx, WIDE, by=["g"]), tx, _asked_pairs(spark, sf_dir))["pairs"]
    return told.select("g", "a", "b", "n_a", "n_b", "co", F.coalesce(F.array_join(F.transform("examples", lambda e: e["tx_id"]), ","), F.lit("")).alias("shown"), "confidence_ab")


@query(
    f"WITH {REGION}, {PAIRS}, recent AS (SELECT *, row_number() OVER (PARTITION BY g, entity ORDER BY seq DESC) AS r FROM touch), "
    "alone AS (SELECT a.g, a, b, r.seq, r.tx_id FROM asked a JOIN recent r ON r.g = a.g AND r.entity = a AND r.r <= 200 JOIN tx ON tx.g = r.g AND tx.seq = r.seq WHERE NOT list_contains(tx.entities, b)) "
    "SELECT * FROM (SELECT g, a, b, tx_id, row_number() OVER (PARTITION BY g, a, b ORDER BY seq DESC)::INT AS rank FROM alone) WHERE rank <= 10"
)
def grouped_changed_alone_region(spark, sf_dir):
    """J5 for many histories."""
    return lookup.changed_alone(region(spark, sf_dir), _asked_pairs(spark, sf_dir), by=["g"]).select("g", "a", "b", "tx_id", "rank")


SEGMENT = (
    "o AS (SELECT c_mktsegment AS g, orders.* FROM orders JOIN customer ON o_custkey = c_custkey), "
    "versions AS (SELECT g, o_orderkey AS seq, o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice / 100000)::BIGINT AS b, lag(o_orderkey) OVER w IS NOT NULL AS has, "
    "lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(floor(o_totalprice / 100000)::BIGINT) OVER w AS b0 FROM o WINDOW w AS (PARTITION BY g ORDER BY o_orderkey)), "
    "diffs AS (SELECT g, seq, list_filter([CASE WHEN p <> p0 THEN 'priority' END, CASE WHEN b <> b0 THEN 'price_band' END, CASE WHEN s <> s0 THEN 'status' END], lambda x: x IS NOT NULL) AS facets FROM versions WHERE has), "
    "touch AS (SELECT g, o_orderkey AS seq, 'order.json' AS entity FROM o UNION SELECT g, l_orderkey, 'flag:' || l_returnflag FROM lineitem JOIN o ON l_orderkey = o_orderkey), "
    "counts AS (SELECT g, entity, count(*) AS n FROM touch GROUP BY ALL), pairs AS (SELECT a.g, a.entity AS trigger, b.entity AS companion, count(*) AS co FROM touch a JOIN touch b ON a.g = b.g AND a.seq = b.seq AND a.entity <> b.entity GROUP BY ALL), "
    f"rules AS (SELECT p.g, trigger, companion, {wilson_sql('co', 'n')} AS raw, n FROM pairs p JOIN counts c ON c.g = p.g AND entity = trigger), "
    "training AS (SELECT g, trigger, companion FROM rules WHERE trigger = 'order.json' AND n >= 10 AND raw >= 0.5), "
    "obs AS (SELECT d.seq, t.g, t.trigger, t.companion, unnest(d.facets) AS facet, EXISTS (SELECT 1 FROM touch x WHERE x.g = d.g AND x.seq = d.seq AND x.entity = t.companion) AS together FROM diffs d JOIN training t ON t.g = d.g), "
    "stats AS (SELECT g, trigger, companion, facet, count(*) AS n, count(*) FILTER (WHERE together) AS co FROM obs GROUP BY ALL)"
)


def segment(spark, sf_dir):
    """(transactions, versions of the document of each segment) of orders."""
    home = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("g"))
    o = b.table(spark, sf_dir, "orders").join(home, "o_custkey")
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 100000).cast("long").alias("price_band")))
    versions = o.select("g", F.col("o_orderkey").alias("seq"), F.lit("order.json").alias("entity"), doc.alias("content"))
    flags = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("flag:"), "l_returnflag").alias("entity")).join(o.select("g", F.col("o_orderkey").alias("seq")), "seq")
    rows = versions.select("g", "seq", "entity").unionByName(flags).groupBy("g", "seq").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return rows.select("g", "seq", F.col("seq").cast("string").alias("tx_id"), F.lit(None).cast("string").alias("label"), "entities"), versions


@query(f"WITH {SEGMENT} SELECT g, trigger, companion, facet, n, co FROM stats")
def grouped_facets_segment(spark, sf_dir):
    """A8, J6, J7, J9, I2 for many histories: one segment new, the others grown from half of their orders."""
    tx, versions = segment(spark, sf_dir)
    tx, contents = written(tx, "segments"), written(baskets.with_previous(versions, "content", ["g"], long=True), "contents")
    path = new_path(spark, "index")
    half = tx.groupBy("g").agg(F.floor(F.max("seq") / 2).alias("_half"))
    old = tx.where("g <> 'BUILDING'").join(half, "g").where("seq <= _half").drop("_half")
    incremental.update_groups(spark, path, old, WIDE, ["g"], contents)
    return incremental.update_groups(spark, path, tx, WIDE, ["g"], contents)[0].facet_stats.select("g", "trigger", "companion", "facet", "n", "co")


def _streamed(spark, rows, parts, config, by=()):
    """The index that a stream makes of rows, which come in so many batches in the order of seq."""
    path, source, rows = new_path(spark, "index"), new_path(spark, "source"), written(rows, "rows")
    least, most = rows.agg(F.min("seq"), F.max("seq") + 1).first()
    for i in range(parts):
        low, high = (least + (most - least) * k // parts for k in (i, i + 1))
        own = rows.where((F.col("seq") >= low) & (F.col("seq") < high))
        own.write.parquet(f"{source}/part={i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        incremental.stream_index(stream, path, config, f"{path}-checkpoint", by).awaitTermination()
    return store.read_index(spark, path, config, by)


@query(f"WITH {SEGMENT} SELECT g, trigger, companion, facet, n, co FROM stats")
def streamed_facets_segment(spark, sf_dir):
    """A stream of orders with the documents they leave."""
    tx, versions = segment(spark, sf_dir)
    docs = versions.select("g", "seq", F.array(F.struct("entity", "content")).alias("versions"))
    index = _streamed(spark, tx.join(docs, ["g", "seq"]), 3, MiningConfig(), ["g"])
    return index.facet_stats.select("g", "trigger", "companion", "facet", "n", "co")


UNITS = (
    "li AS (SELECT l_orderkey AS k, n_name AS unit, count(*)::VARCHAR AS text FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), "
    "prev AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), "
    "aft AS (SELECT prev.k AS seq, unit, text FROM prev JOIN li ON li.k = prev.k), bef AS (SELECT prev.k AS seq, unit, text FROM prev JOIN li ON li.k = prev.p), "
    "t AS (SELECT seq, coalesce(aft.unit, bef.unit) AS unit FROM aft FULL JOIN bef USING (seq, unit) WHERE aft.text IS DISTINCT FROM bef.text)"
)


@query(f"WITH {UNITS} SELECT a.unit AS entity_a, b.unit AS entity_b, count(*) AS co FROM t a JOIN t b ON a.seq = b.seq AND a.unit < b.unit GROUP BY ALL")
def streamed_units_orders(spark, sf_dir):
    """A stream of orders with the lines they leave, by nation, in a file for each customer."""
    s = b.table(spark, sf_dir, "supplier").join(b.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("unit_id"))
    li = b.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("seq"), "unit_id").agg(F.count(F.lit(1)).cast("string").alias("text"))
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.col("o_custkey").cast("string"), F.lit(".cs")).alias("entity"))
    rows = o.join(li, "seq", "left").groupBy("seq", "entity").agg(F.collect_list(F.struct("entity", "unit_id", "text")).alias("units"))
    tx = rows.select("seq", F.col("seq").cast("string").alias("tx_id"), F.lit(None).cast("string").alias("label"), F.array("entity").alias("entities"), "units")
    return _streamed(spark, tx, 3, MiningConfig()).pairs.select("entity_a", "entity_b", "co")


REPLAY = ReplayConfig(lookahead=2, caps=(3, 5), baseline_cap=3, floors=(0.5, 0.6))


def _replay_groups_sql() -> str:
    one = lambda g: b._replay_sql(
        b._tx_sql(f"SELECT CAST(floor(epoch(ts) / 259200) AS BIGINT) AS w, user_id, event_type AS entity FROM events WHERE user_id % 3 = {g}", "w || '/' || user_id", "w, user_id"),
        REPLAY.caps, REPLAY.baseline_cap, REPLAY.floors, REPLAY.lookahead,
    )
    return " UNION ALL ".join(f"SELECT {g}::BIGINT AS g, * FROM ({one(g)})" for g in range(3))


@query(_replay_groups_sql())
def grouped_replay_cohort(spark, sf_dir):
    """A10, J17, J18, J19 for many histories, each with a holdout of its own."""
    return replay(cohort(spark, sf_dir), REPLAY, ["g"]).withColumn("g", F.col("g").cast("long"))


@query(
    f"WITH {REGION}, d AS (SELECT g, least(100, count(*) // 2) AS h, count(*) AS total FROM tx GROUP BY g), k AS (SELECT tx.g, seq - (total - h) AS pos, h, len(entities) AS size FROM tx JOIN d ON d.g = tx.g) "
    "SELECT g, count(*) FILTER (WHERE pos < h - 10 AND size <= 15) AS evaluated, count(*) FILTER (WHERE pos < h - 10 AND size > 15) AS skipped_large, count(*) FILTER (WHERE pos >= h - 10) AS ingest_only FROM k WHERE pos >= 0 GROUP BY g"
)
def grouped_replay_coverage_region(spark, sf_dir):
    """A12 for many histories."""
    return replay_coverage(region(spark, sf_dir), ReplayConfig(holdout=100, max_eval_size=15), ["g"])
