"""Queries over the given tables, one or more for each operation, with the SQL that gives the same rows.

Baskets: ev3d and evweek (what a user did in three days, in a week), custnat (nations a customer is supplied from),
ordbrand (brands of an order), orddoc (an order's document next to the flags of its lines) and ordunit (an order's lines
by nation as units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.config import MiningConfig
from basketwise.functions import scoring
from basketwise.functions.json_diff import json_changed_facets
from basketwise.functions.scoring import wilson_sql
from basketwise.operators import facets, lookup, mining, mutes, units
from basketwise.plans.replay import ReplayConfig, replay, replay_coverage
from basketwise.sources import baskets
from basketwise.sources.store import trim_by_size

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- baskets ----------------------------------------------------------------------------------------------------


def _events(spark, sf_dir, seconds):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select(F.floor(t / seconds).cast("long").alias("w"), "user_id", "event_type")
    return baskets.assemble_transactions(rows, ["w", "user_id"], "event_type", ["w", "user_id"])


def ev3d(spark, sf_dir):
    return _events(spark, sf_dir, 259200)


def evweek(spark, sf_dir):
    return _events(spark, sf_dir, 604800)


def custnat(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("o_custkey", "n_name").distinct()
    return baskets.assemble_transactions(rows, ["o_custkey"], "n_name", ["o_custkey"])


def ordbrand(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return baskets.assemble_transactions(rows, ["l_orderkey"], "p_brand", ["l_orderkey"])


def _tx_sql(rows: str, tx_id: str, order: str) -> str:
    return (
        f"raw AS ({rows}), grouped AS (SELECT {tx_id} AS tx_id, {order}, list_sort(list(DISTINCT entity)) AS entities FROM raw GROUP BY ALL), "
        f"tx AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS seq, tx_id, entities FROM grouped), "
        "touch AS (SELECT seq, tx_id, unnest(entities) AS entity FROM tx), "
        "counts AS (SELECT entity, count(*) AS n FROM touch GROUP BY entity), "
        "events2 AS (SELECT a.seq, a.tx_id, a.entity AS entity_a, b.entity AS entity_b FROM touch a JOIN touch b ON a.seq = b.seq AND a.entity < b.entity), "
        "pairs AS (SELECT entity_a, entity_b, count(*) AS co FROM events2 GROUP BY ALL), "
        "dir2 AS (SELECT entity_a AS trigger, entity_b AS companion, co FROM pairs UNION ALL SELECT entity_b, entity_a, co FROM pairs), "
        f"rules AS (SELECT trigger, companion, co, n, {wilson_sql('co', 'n')} AS raw, round_even({wilson_sql('co', 'n')}, 4) AS confidence FROM dir2 JOIN counts ON entity = trigger)"
    )


def _events_sql(seconds: int) -> str:
    return _tx_sql(
        f"SELECT CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS w, user_id, event_type AS entity FROM events",
        "w || '/' || user_id", "w, user_id",
    )


EV3D, EVWEEK = _events_sql(259200), _events_sql(604800)
CUSTNAT = _tx_sql(
    "SELECT DISTINCT o_custkey, n_name AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "o_custkey::VARCHAR", "o_custkey",
)
ORDBRAND = _tx_sql("SELECT l_orderkey, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey", "l_orderkey::VARCHAR", "l_orderkey")


def _joined(column: str = "entities"):
    return F.array_join(column, ",").alias(column)


@query(f"WITH {EV3D} SELECT seq, tx_id, array_to_string(entities, ',') AS entities FROM tx")
def baskets_ev3d(spark, sf_dir):
    """S2, W5."""
    return ev3d(spark, sf_dir).select("seq", "tx_id", _joined())


@query(f"WITH {EV3D} SELECT seq, tx_id, array_to_string(entities, ',') AS entities FROM tx WHERE len(entities) BETWEEN 1 AND 3")
def clean_ev3d_cap3(spark, sf_dir):
    """F2."""
    return baskets.clean_transactions(ev3d(spark, sf_dir), 3).select("seq", "tx_id", _joined())


@query(f"WITH {EVWEEK} SELECT seq, tx_id FROM tx WHERE seq > (SELECT max(seq) FROM tx) - 100")
def window_evweek(spark, sf_dir):
    """F5."""
    return baskets.history_window(evweek(spark, sf_dir), 100).select("seq", "tx_id")


@query(f"WITH {CUSTNAT} SELECT seq, tx_id FROM tx WHERE seq > (SELECT seq FROM tx WHERE tx_id = (SELECT max(o_custkey // 2)::VARCHAR FROM orders))")
def since_custnat(spark, sf_dir):
    """what came after the customer in the middle."""
    mark = table(spark, sf_dir, "orders").agg(F.max(F.floor(F.col("o_custkey") / 2)).cast("string")).first()[0]
    tx = custnat(spark, sf_dir)
    found = baskets.since(tx, mark)
    return (tx.limit(0) if found is None else found).select("seq", "tx_id")


@query(f"WITH {CUSTNAT} SELECT entity, n FROM counts")
def entity_counts_custnat(spark, sf_dir):
    """A1."""
    return mining.entity_counts(custnat(spark, sf_dir))


@query(f"WITH {ORDBRAND} SELECT entity_a, entity_b, co FROM pairs")
def pair_counts_ordbrand(spark, sf_dir):
    """J1, A2."""
    return mining.pair_counts(ordbrand(spark, sf_dir))


@query(
    f"WITH {CUSTNAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY seq DESC) AS r FROM events2) "
    "SELECT entity_a, entity_b, string_agg(tx_id, ',' ORDER BY r) AS examples FROM ranked WHERE r <= 10 GROUP BY ALL"
)
def pair_examples_custnat(spark, sf_dir):
    """A3, W6."""
    found = mining.pair_examples(custnat(spark, sf_dir), 10)
    return found.select("entity_a", "entity_b", F.array_join(F.transform("recent", lambda x: x["tx_id"]), ",").alias("examples"))


@query(f"WITH {CUSTNAT} SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM counts) AS entities, (SELECT count(*) FROM pairs) AS pairs, 0::BIGINT AS trained_triggers")
def index_totals_custnat(spark, sf_dir):
    """A4."""
    tx = custnat(spark, sf_dir)
    return mining.index_totals(tx, mining.entity_counts(tx), mining.pair_counts(tx))


def _rules(tx):
    return mining.directed_rules(mining.pair_counts(tx), mining.entity_counts(tx))


@query(f"WITH {CUSTNAT} SELECT trigger, companion, co, n, confidence FROM rules")
def directed_rules_custnat(spark, sf_dir):
    """M1, M2, M3."""
    return _rules(custnat(spark, sf_dir)).select("trigger", "companion", "co", "n", "confidence")


@query(f"WITH {CUSTNAT} SELECT trigger, companion, confidence FROM rules WHERE n >= 10 AND raw >= 0.7")
def rules_at_custnat(spark, sf_dir):
    """M4."""
    return mining.rules_at(_rules(custnat(spark, sf_dir)), 0.7).select("trigger", "companion", "confidence")


@query(
    f"WITH {CUSTNAT} SELECT floor::DOUBLE AS floor, count(*) FILTER (WHERE n >= 10 AND raw >= floor::DOUBLE) AS rules "
    "FROM rules, (VALUES (0.5), (0.6), (0.7), (0.8)) AS f(floor) GROUP BY floor"
)
def rules_at_floors_custnat(spark, sf_dir):
    """A5, E4."""
    return mining.rules_at_floors(_rules(custnat(spark, sf_dir)))


@query(
    f"WITH {CUSTNAT}, sized AS (SELECT len(entities) AS size FROM tx) SELECT CASE WHEN size <= 5 THEN '1-5' WHEN size <= 10 THEN '6-10' WHEN size <= 20 THEN '11-20' "
    "WHEN size <= 30 THEN '21-30' ELSE '31-50' END AS bucket, count(*) AS transactions, count(*) / (SELECT count(*) FROM sized) AS share, "
    "(SELECT count(*) FILTER (WHERE size > 20) / count(*) FROM sized) AS over_cap_share FROM sized WHERE size > 0 GROUP BY 1"
)
def size_histogram_custnat(spark, sf_dir):
    """A6."""
    return mining.size_histogram(custnat(spark, sf_dir), 20)


@query("SELECT l_partkey::VARCHAR AS entity, max_by(l_suppkey::VARCHAR, (l_orderkey, l_linenumber)) AS location FROM lineitem GROUP BY l_partkey")
def locations_lineitem(spark, sf_dir):
    """The supplier that last delivered each part."""
    seen = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("entity"), F.col("l_suppkey").cast("string").alias("location"),
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("ord"),
    )
    return mining.entity_locations(seen)


# ---- asking -----------------------------------------------------------------------------------------------------


def _sets(tx):
    return tx.select(F.col("tx_id").alias("change_set_id"), F.explode("entities").alias("entity"))


HOLES = (
    "cand AS (SELECT t.tx_id AS change_set_id, r.companion AS hole, r.trigger, r.confidence, r.raw, r.co, r.n FROM touch t JOIN rules r ON r.trigger = t.entity "
    "WHERE r.n >= 10 AND r.raw >= {floor} AND NOT EXISTS (SELECT 1 FROM touch p WHERE p.seq = t.seq AND p.entity = r.companion)), "
    "holes AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY change_set_id, hole ORDER BY confidence DESC, raw DESC, trigger) = 1)"
)


def _holes(tx, floor=0.6):
    return lookup.find_holes(_rules(tx), _sets(tx), floor)


@query(
    f"WITH {EV3D}, {HOLES.format(floor=0.6)} SELECT change_set_id, hole, trigger, confidence, co, n, "
    "row_number() OVER (PARTITION BY change_set_id ORDER BY confidence DESC, hole)::INT AS rank FROM holes"
)
def check_holes_ev3d(spark, sf_dir):
    """What every user window lacks."""
    found = lookup.ordered_holes(_holes(ev3d(spark, sf_dir)))
    return found.select("change_set_id", "hole", "trigger", "confidence", "co", "n", "rank")


@query(f"WITH {EVWEEK}, {HOLES.format(floor=0.85)} SELECT change_set_id, hole, trigger, confidence FROM holes")
def check_holes_evweek(spark, sf_dir):
    """J2 at a high floor."""
    return _holes(evweek(spark, sf_dir), 0.85).select("change_set_id", "hole", "trigger", "confidence")


@query(f"WITH {ORDBRAND}, {HOLES.format(floor=0.15)} SELECT change_set_id, hole, trigger, confidence FROM holes")
def check_holes_ordbrand(spark, sf_dir):
    """J2 on a table with weak rules."""
    return _holes(ordbrand(spark, sf_dir), 0.15).select("change_set_id", "hole", "trigger", "confidence")


@query(
    f"WITH {CUSTNAT} SELECT * FROM (SELECT trigger, companion, confidence, co, row_number() OVER (PARTITION BY trigger ORDER BY confidence DESC, co DESC, companion)::INT AS rank FROM rules) WHERE rank <= 5"
)
def companions_custnat(spark, sf_dir):
    """W2, O2, E2."""
    return lookup.top_companions(_rules(custnat(spark, sf_dir)), 5).select("trigger", "companion", "confidence", "co", "rank")


@query(
    f"WITH {CUSTNAT}, asked AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name), "
    "full_ AS (SELECT a, b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(co, 0) AS co FROM asked LEFT JOIN counts x ON x.entity = a LEFT JOIN counts y ON y.entity = b "
    "LEFT JOIN pairs p ON p.entity_a = least(a, b) AND p.entity_b = greatest(a, b)) "
    f"SELECT a, b, n_a, n_b, co, round_even({wilson_sql('co', 'n_a')}, 4) + 0.0 AS confidence_ab, round_even({wilson_sql('co', 'n_b')}, 4) + 0.0 AS confidence_ba, "
    f"n_a >= 10 AND {wilson_sql('co', 'n_a')} >= 0.6 AS is_rule_ab, n_b >= 10 AND {wilson_sql('co', 'n_b')} >= 0.6 AS is_rule_ba FROM full_"
)
def explain_pairs_custnat(spark, sf_dir):
    """Every two nations of a region."""
    tx, n = custnat(spark, sf_dir), table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    asked = a.join(b, "n_regionkey").where("a <> b").select("a", "b")
    return lookup.explain_pairs(mining.entity_counts(tx), mining.pair_counts(tx), asked)


@query(
    f"WITH {CUSTNAT}, recent AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS r FROM touch), "
    "asked AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name), "
    "alone AS (SELECT a, b, r.seq, r.tx_id FROM asked JOIN recent r ON r.entity = a AND r.r <= 200 JOIN tx ON tx.seq = r.seq WHERE NOT list_contains(tx.entities, b)) "
    "SELECT * FROM (SELECT a, b, tx_id, row_number() OVER (PARTITION BY a, b ORDER BY seq DESC)::INT AS rank FROM alone) WHERE rank <= 10"
)
def changed_alone_custnat(spark, sf_dir):
    """J5, F8, O3."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    asked = a.join(b, "n_regionkey").where("a <> b").select("a", "b")
    return lookup.changed_alone(custnat(spark, sf_dir), asked).select("a", "b", "tx_id", "rank")


@query(
    f"WITH {CUSTNAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY seq DESC) AS r FROM events2), "
    "lab AS (SELECT c_custkey::VARCHAR AS tx_id, c_name AS label FROM customer) "
    "SELECT entity_a, entity_b, string_agg(r.tx_id || '=' || coalesce(label, '?'), ',' ORDER BY r) AS shown FROM ranked r LEFT JOIN lab USING (tx_id) WHERE r <= 3 GROUP BY ALL"
)
def resolved_examples_custnat(spark, sf_dir):
    """J3."""
    found = mining.pair_examples(custnat(spark, sf_dir), 10).withColumn("examples", F.transform("recent", lambda x: x["tx_id"]))
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tx_id"), F.col("c_name").alias("label"))
    shown = lookup.resolve_examples(found.drop("recent"), labels, 3, ["entity_a", "entity_b"])
    text = F.transform("examples", lambda x: F.concat(x["tx_id"], F.lit("="), F.coalesce(x["label"], F.lit("?"))))
    return shown.select("entity_a", "entity_b", F.array_join(text, ",").alias("shown"))


@query(
    f"WITH {CUSTNAT}, cited AS (SELECT DISTINCT tx_id FROM (SELECT tx_id, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY seq DESC) AS r FROM events2) WHERE r <= 2) "
    "SELECT c_custkey::VARCHAR AS tx_id, c_name AS label FROM customer SEMI JOIN cited ON cited.tx_id = c_custkey::VARCHAR"
)
def pruned_labels_custnat(spark, sf_dir):
    """S5."""
    pairs = mining.pairs_with_examples(custnat(spark, sf_dir), 2)
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tx_id"), F.col("c_name").alias("label"))
    return mining.prune_labels(labels, pairs)


def _asked_sets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("change_set_id"), F.col("n_name").alias("entity"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("change_set_id"), F.col("r_name").alias("entity")))


ASKED = "sets AS (SELECT n_regionkey::VARCHAR AS change_set_id, n_name AS entity FROM nation UNION SELECT r_regionkey::VARCHAR, r_name FROM region)"


@query(
    f"WITH {CUSTNAT}, {ASKED} SELECT change_set_id, count(*) AS inputs, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS unknown, "
    "count(*) FILTER (WHERE coalesce(n, 0) > 0 AND n < 1000) AS thin FROM sets LEFT JOIN counts USING (entity) GROUP BY 1"
)
def coverage_custnat(spark, sf_dir):
    """A11."""
    return lookup.coverage(_asked_sets(spark, sf_dir), mining.entity_counts(custnat(spark, sf_dir)), 1000)


@query(f"WITH {CUSTNAT}, {ASKED} SELECT change_set_id, entity, coalesce(n, 0) AS n, coalesce(n, 0) >= 10 AS can_trigger FROM sets LEFT JOIN counts USING (entity)")
def checked_entities_custnat(spark, sf_dir):
    """J15."""
    return lookup.checked_entities(_asked_sets(spark, sf_dir), mining.entity_counts(custnat(spark, sf_dir)))


GATE = (
    "SELECT s.change_set_id, count(h.hole) AS holes, count(*) FILTER (WHERE h.suppressed) AS suppressed, "
    "coalesce(bool_or(NOT h.suppressed AND h.confidence >= 0.7), false) AS failing FROM (SELECT DISTINCT tx_id AS change_set_id FROM touch) s LEFT JOIN marked h USING (change_set_id) GROUP BY 1"
)


@query(f"WITH {EV3D}, {HOLES.format(floor=0.6)}, marked AS (SELECT *, false AS suppressed FROM holes) {GATE}")
def gate_ev3d(spark, sf_dir):
    """A9."""
    tx = ev3d(spark, sf_dir)
    return lookup.gate(_holes(tx), _sets(tx), 0.7)


def _mutes(counts):
    """A mute on every ordered pair of entities whose names begin in the same half of the alphabet, every other expired."""
    a, b = counts.select(F.col("entity").alias("trigger"), "n"), counts.select(F.col("entity").alias("hole"), F.col("n").alias("m"))
    return a.join(b, F.col("trigger") < F.col("hole")).select(
        "trigger", "hole", F.when(F.col("m") % 2 == 0, F.col("n") + 5).otherwise(F.col("n")).alias("until_trigger_changes"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("note"),
    )


MUTES = (
    "mutes AS (SELECT a.entity AS trigger, b.entity AS hole, CASE WHEN b.n % 2 = 0 THEN a.n + 5 ELSE a.n END AS until_, a.n AS n FROM counts a JOIN counts b ON a.entity < b.entity), "
    "marked AS (SELECT h.*, m.until_ IS NOT NULL AS suppressed, CASE WHEN m.until_ IS NOT NULL THEN 'muted for ' || (m.until_ - m.n) || ' more changes of ' || h.trigger END AS reason "
    "FROM holes h LEFT JOIN mutes m ON m.trigger = h.trigger AND m.hole = h.hole AND m.until_ > m.n)"
)


@query(f"WITH {EV3D}, {HOLES.format(floor=0.6)}, {MUTES} SELECT change_set_id, hole, trigger, confidence, suppressed, reason FROM marked")
def muted_holes_ev3d(spark, sf_dir):
    """J12, X7."""
    tx = ev3d(spark, sf_dir)
    counts = mining.entity_counts(tx)
    return mutes.apply_ignores(_holes(tx), _mutes(counts), counts).select("change_set_id", "hole", "trigger", "confidence", "suppressed", "reason")


@query(f"WITH {EV3D}, {HOLES.format(floor=0.6)}, {MUTES} {GATE}")
def muted_gate_ev3d(spark, sf_dir):
    """A9 after J12."""
    tx = ev3d(spark, sf_dir)
    counts = mining.entity_counts(tx)
    return lookup.gate(mutes.apply_ignores(_holes(tx), _mutes(counts), counts), _sets(tx), 0.7)


@query(f"WITH {EV3D}, {HOLES.format(floor=0.6)}, {MUTES} SELECT change_set_id, hole, trigger FROM marked WHERE NOT suppressed")
def kept_holes_ev3d(spark, sf_dir):
    """J13."""
    tx = ev3d(spark, sf_dir)
    counts = mining.entity_counts(tx)
    return mutes.split_ignored(_holes(tx), _mutes(counts), counts)[0].select("change_set_id", "hole", "trigger")


@query(f"WITH {CUSTNAT}, {MUTES.split(', marked')[0]} SELECT trigger, hole, until_ - n AS remaining FROM mutes WHERE until_ > n")
def mute_status_custnat(spark, sf_dir):
    """J14."""
    counts = mining.entity_counts(custnat(spark, sf_dir))
    return mutes.mute_status(_mutes(counts), counts).where("remaining > 0").select("trigger", "hole", "remaining")


# ---- replay -----------------------------------------------------------------------------------------------------


def _replay_sql(tx: str, caps, base: int, floors, lookahead: int = 1, holdout: int = 2000, support: int = 10) -> str:
    low = min(floors)
    cap_rows = ", ".join(f"({c})" for c in caps)
    floor_rows = ", ".join(f"({f}::DOUBLE)" for f in floors)
    return (
        f"WITH {tx}, dims AS (SELECT count(*) AS total, least({holdout}, count(*) // 2) AS h FROM tx), caps(cap) AS (VALUES {cap_rows}), floors(floor) AS (VALUES {floor_rows}), "
        "hist AS (SELECT seq - (total - h) AS pos, entities, len(entities) AS size, h FROM tx, dims), "
        "ev AS (SELECT pos, size, h, unnest(entities) AS e FROM hist), "
        "na AS (SELECT cap, p.pos, p.e AS a, (SELECT count(*) FROM ev x WHERE x.e = p.e AND x.pos < p.pos AND x.size <= cap) AS n FROM ev p, caps WHERE p.pos >= 0 AND p.pos < p.h - " + str(lookahead) + "), "
        "pe AS (SELECT x.pos, x.size, x.e AS a, y.e AS b FROM ev x JOIN ev y ON x.pos = y.pos AND x.e <> y.e), "
        "run AS (SELECT cap, a, b, pos, count(*) OVER (PARTITION BY cap, a, b ORDER BY pos) AS co FROM pe, caps WHERE size <= cap), "
        "ab AS (SELECT DISTINCT a, b FROM pe), "
        "probe AS (SELECT na.cap, na.pos, na.a, ab.b, na.n FROM na JOIN ab ON ab.a = na.a WHERE na.n >= " + str(support) + " AND NOT EXISTS (SELECT 1 FROM ev z WHERE z.pos = na.pos AND z.e = ab.b)), "
        "st AS (SELECT p.cap, p.pos - 1 AS upto, p.pos, p.a, p.b, p.n FROM probe p), "
        "j AS (SELECT st.cap, st.pos, st.b, st.n, r.co FROM st ASOF JOIN run r ON st.cap = r.cap AND st.a = r.a AND st.b = r.b AND st.upto >= r.pos), "
        f"conf AS (SELECT cap, pos, b, max(round_even({wilson_sql('co', 'n')}, 4)) AS c FROM j WHERE {wilson_sql('co', 'n')} >= {low}::DOUBLE GROUP BY ALL), "
        f"fl AS (SELECT conf.*, EXISTS (SELECT 1 FROM ev x WHERE x.e = conf.b AND x.pos > conf.pos AND x.pos <= conf.pos + {lookahead}) AS filled FROM conf), "
        f"cells AS (SELECT f.cap, floor, count(*) AS holes, count(*) FILTER (WHERE filled) AS filled, count(*) FILTER (WHERE f.cap <> {base} AND coalesce(g.c, -1) < floor) AS marginal_holes, "
        f"count(*) FILTER (WHERE filled AND f.cap <> {base} AND coalesce(g.c, -1) < floor) AS marginal_filled FROM fl f JOIN floors ON f.c >= floor "
        f"LEFT JOIN conf g ON g.cap = {base} AND g.pos = f.pos AND g.b = f.b GROUP BY ALL), "
        "fn AS (SELECT cap, e AS a, count(*) AS n FROM ev, caps WHERE size <= cap GROUP BY ALL), fco AS (SELECT cap, a, b, count(*) AS co FROM pe, caps WHERE size <= cap GROUP BY ALL), "
        f"fr AS (SELECT cap, floor, count(*) AS rules FROM fco JOIN fn USING (cap, a), floors WHERE n >= {support} AND {wilson_sql('co', 'n')} >= floor GROUP BY ALL) "
        "SELECT cap, floor, coalesce(rules, 0) AS rules, coalesce(holes, 0) AS holes, coalesce(filled, 0) AS filled, filled / nullif(holes, 0) AS fill_rate, "
        "coalesce(marginal_holes, 0) AS marginal_holes, coalesce(marginal_filled, 0) AS marginal_filled, marginal_filled / nullif(marginal_holes, 0) AS marginal_rate "
        "FROM caps CROSS JOIN floors LEFT JOIN cells USING (cap, floor) LEFT JOIN fr USING (cap, floor)"
    )


REPLAY_CUSTNAT = ReplayConfig(lookahead=1, caps=(10, 15, 20, 25), baseline_cap=20, floors=(0.5, 0.6, 0.7, 0.8))
REPLAY_EV3D = ReplayConfig(lookahead=1, caps=(3, 4, 5), baseline_cap=4, floors=(0.5, 0.6, 0.7))


@query(_replay_sql(CUSTNAT, REPLAY_CUSTNAT.caps, 20, REPLAY_CUSTNAT.floors))
def replay_custnat(spark, sf_dir):
    """I6, E6, J17, J18, J19, W3, W4, A10."""
    return replay(custnat(spark, sf_dir), REPLAY_CUSTNAT)


@query(_replay_sql(EV3D, REPLAY_EV3D.caps, 4, REPLAY_EV3D.floors))
def replay_ev3d(spark, sf_dir):
    """I6 on a dense table."""
    return replay(ev3d(spark, sf_dir), REPLAY_EV3D)


@query(
    f"WITH {CUSTNAT}, dims AS (SELECT count(*) AS total, least(2000, count(*) // 2) AS h FROM tx), x AS (SELECT seq - (total - h) AS k, len(entities) AS size, h FROM tx, dims WHERE seq >= total - h) "
    "SELECT count(*) FILTER (WHERE k < h - 10 AND size <= 15) AS evaluated, count(*) FILTER (WHERE k < h - 10 AND size > 15) AS skipped_large, count(*) FILTER (WHERE k >= h - 10) AS ingest_only FROM x"
)
def replay_coverage_custnat(spark, sf_dir):
    """A12."""
    return replay_coverage(custnat(spark, sf_dir), ReplayConfig(max_eval_size=15))


# ---- documents, paths, names --------------------------------------------------------------------------------------


@query(
    "WITH x AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source) AS all_, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS run_, "
    "row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) SELECT source, doc_id, n_chars FROM x WHERE all_ <= 100000 OR run_ <= 50000 OR r = 1"
)
def retention_documents(spark, sf_dir):
    """S7."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return trim_by_size(docs, "doc_id", "n_chars", 100_000, 50_000, "source")


@query(
    "SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(url, '^https?://', '/'), '\\', '/'), '^(\\./)+', ''), '^/+', '') AS entity, "
    "regexp_replace(url, '^https?://[^/]+/+', '') AS below_root FROM pages"
)
def normalized_pages(spark, sf_dir):
    """paths of urls, with and without their host as root."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?://", "/")
    root = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/]+)", 1))
    return p.select("page_id", scoring.normalize_path(path).alias("entity"), scoring.normalize_path(path, root).alias("below_root"))


# ---- documents of orders and their keys ---------------------------------------------------------------------------

FACETS = MiningConfig(facet_floor=0.728)


def _order_versions(spark, sf_dir):
    """(seq, entity, before, after): the document of an order and of the customer's order before it."""
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 100000).cast("long").alias("price_band")))
    versions = o.select("o_custkey", F.col("o_orderkey").alias("seq"), F.lit("order.json").alias("entity"), doc.alias("doc"))
    return baskets.with_previous(versions, "doc", ["o_custkey"]).select("seq", "entity", "before", "after")


def orddoc(spark, sf_dir):
    """Transactions keyed by order: its document and the return flags of its lines."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("order.json").alias("entity"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("flag:"), "l_returnflag").alias("entity"))
    rows = o.unionByName(li).groupBy("seq").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return rows.select("seq", F.col("seq").cast("string").alias("tx_id"), F.lit(None).cast("string").alias("label"), "entities")


ORDDOC = (
    "versions AS (SELECT o_orderkey AS seq, o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice / 100000)::BIGINT AS b, lag(o_orderkey) OVER w IS NOT NULL AS has, "
    "lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(floor(o_totalprice / 100000)::BIGINT) OVER w AS b0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), "
    "diffs AS (SELECT seq, list_filter([CASE WHEN p <> p0 THEN 'priority' END, CASE WHEN b <> b0 THEN 'price_band' END, CASE WHEN s <> s0 THEN 'status' END], lambda x: x IS NOT NULL) AS facets FROM versions WHERE has), "
    "raw AS (SELECT o_orderkey AS seq, 'order.json' AS entity FROM orders UNION SELECT l_orderkey, 'flag:' || l_returnflag FROM lineitem), touch AS (SELECT DISTINCT seq, seq::VARCHAR AS tx_id, entity FROM raw), "
    "counts AS (SELECT entity, count(*) AS n FROM touch GROUP BY 1), pairs AS (SELECT a.entity AS trigger, b.entity AS companion, count(*) AS co FROM touch a JOIN touch b ON a.seq = b.seq AND a.entity <> b.entity GROUP BY ALL), "
    f"rules AS (SELECT trigger, companion, co, n, {wilson_sql('co', 'n')} AS raw, round_even({wilson_sql('co', 'n')}, 4) AS confidence FROM pairs JOIN counts ON entity = trigger), "
    "training AS (SELECT trigger, companion FROM rules WHERE trigger = 'order.json' AND n >= 10 AND raw >= 0.5), "
    "obs AS (SELECT d.seq, t.trigger, t.companion, unnest(d.facets) AS facet, EXISTS (SELECT 1 FROM touch x WHERE x.seq = d.seq AND x.entity = t.companion) AS together FROM diffs d, training t), "
    "stats AS (SELECT trigger, companion, facet, count(*) AS n, count(*) FILTER (WHERE together) AS co FROM obs GROUP BY ALL), "
    f"classed AS (SELECT *, CASE WHEN n < 5 THEN 'unknown' WHEN {wilson_sql('co', 'n')} >= 0.728::DOUBLE THEN 'predictive' ELSE 'non_predictive' END AS class FROM stats)"
)


@query(f"WITH {ORDDOC} SELECT seq, array_to_string(list_sort(facets), ',') AS facets FROM diffs")
def json_facets_orddoc(spark, sf_dir):
    """X1, W7."""
    v = _order_versions(spark, sf_dir).where("before is not null")
    return v.select("seq", F.array_join(json_changed_facets(F.col("before"), F.col("after")), ",").alias("facets"))


@query(f"WITH {ORDDOC} SELECT * FROM training")
def facet_candidates_orddoc(spark, sf_dir):
    """J6, F6."""
    return facets.facet_candidates(_rules(orddoc(spark, sf_dir)), FACETS)


def _facets(spark, sf_dir):
    tx = orddoc(spark, sf_dir)
    training = facets.facet_candidates(_rules(tx), FACETS)
    diffs = facets.content_diffs(_order_versions(spark, sf_dir), training, FACETS)
    return tx, training, diffs, facets.facet_stats(facets.facet_observations(diffs, training, tx))


@query(f"WITH {ORDDOC} SELECT trigger, companion, facet, n, co FROM stats")
def facet_stats_orddoc(spark, sf_dir):
    """J7, A8."""
    return _facets(spark, sf_dir)[3]


@query(f"WITH {ORDDOC} SELECT trigger, companion, facet, n, co, round_even({wilson_sql('co', 'n')}, 4) AS confidence, class FROM classed")
def facet_breakdown_orddoc(spark, sf_dir):
    """J11, X5."""
    return facets.facet_breakdown(_facets(spark, sf_dir)[3], FACETS)


@query(
    f"WITH {ORDDOC}, holes AS (SELECT t.seq, r.trigger, r.companion AS hole, r.confidence FROM touch t JOIN rules r ON r.trigger = t.entity WHERE r.trigger = 'order.json' AND r.n >= 10 AND r.raw >= 0.5 "
    "AND NOT EXISTS (SELECT 1 FROM touch p WHERE p.seq = t.seq AND p.entity = r.companion)), "
    "verdict AS (SELECT d.seq, c.companion, count(*) = len(any_value(d.facets)) AND bool_and(class = 'non_predictive') AS ok FROM diffs d JOIN classed c ON list_contains(d.facets, c.facet) GROUP BY ALL) "
    "SELECT h.seq::VARCHAR AS change_set_id, h.trigger, h.hole, h.confidence, coalesce(v.ok, false) AS suppressed FROM holes h LEFT JOIN verdict v ON v.seq = h.seq AND v.companion = h.hole"
)
def suppressed_holes_orddoc(spark, sf_dir):
    """J10, J8."""
    tx, training, diffs, stats = _facets(spark, sf_dir)
    rules = _rules(tx).where(F.col("trigger") == "order.json")
    holes = lookup.find_holes(rules, _sets(tx), 0.5)
    changed = diffs.select(F.col("seq").cast("string").alias("change_set_id"), F.col("entity").alias("trigger"), "facets")
    return facets.evaluate_suppression(holes, changed, stats, training, FACETS).select("change_set_id", "trigger", "hole", "confidence", "suppressed")


@query(
    f"WITH {ORDDOC} SELECT DISTINCT t.trigger, t.companion FROM training t WHERE EXISTS (SELECT 1 FROM training u WHERE u.companion <> 'flag:A')"
)
def backfill_orddoc(spark, sf_dir):
    """Only one companion had been trained before."""
    candidates = facets.facet_candidates(_rules(orddoc(spark, sf_dir)), FACETS)
    return facets.backfill_plan(candidates, candidates.where(F.col("companion") == "flag:A"))


# ---- units of orders ------------------------------------------------------------------------------------------------


def _unit_versions(spark, sf_dir):
    """Lines by supplier nation of each order (after) and of the customer's order before it (before)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("unit_id"))
    li = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("o_orderkey"), "unit_id").agg(F.count(F.lit(1)).cast("string").alias("text"))
    from pyspark.sql import Window

    order = o.withColumn("prev", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("prev is not null")
    name = F.lit("lines.cs").alias("entity")
    after = order.join(li, "o_orderkey").select(F.col("o_orderkey").alias("seq"), name, F.lit("after").alias("side"), "unit_id", "text")
    before = order.select(F.col("o_orderkey").alias("seq"), F.col("prev").alias("o_orderkey")).join(li, "o_orderkey").select("seq", name, F.lit("before").alias("side"), "unit_id", "text")
    return after.unionByName(before)


ORDUNIT = (
    "li AS (SELECT l_orderkey AS k, n_name AS unit, count(*)::VARCHAR AS text FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), "
    "prev AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), "
    "aft AS (SELECT prev.k AS seq, unit, text FROM prev JOIN li ON li.k = prev.k WHERE p IS NOT NULL), bef AS (SELECT prev.k AS seq, unit, text FROM prev JOIN li ON li.k = prev.p WHERE p IS NOT NULL), "
    "ch AS (SELECT seq, coalesce(aft.unit, bef.unit) AS unit, aft.text IS DISTINCT FROM bef.text AS changed FROM aft FULL JOIN bef USING (seq, unit))"
)


@query(f"WITH {ORDUNIT} SELECT seq, coalesce(string_agg(unit, ',' ORDER BY unit) FILTER (WHERE changed), '') AS units FROM ch GROUP BY seq")
def changed_units_ordunit(spark, sf_dir):
    """X2, X3."""
    return units.changed_units(_unit_versions(spark, sf_dir)).select("seq", F.array_join("units", ",").alias("units"))


@query(f"WITH {ORDUNIT}, t AS (SELECT seq, unit FROM ch WHERE changed) SELECT a.unit AS entity_a, b.unit AS entity_b, count(*) AS co FROM t a JOIN t b ON a.seq = b.seq AND a.unit < b.unit GROUP BY ALL")
def unit_pairs_ordunit(spark, sf_dir):
    """Pairs of units changed in one order."""
    u = _unit_versions(spark, sf_dir)
    tx = u.select("seq").distinct().select("seq", F.col("seq").cast("string").alias("tx_id"), F.lit(None).cast("string").alias("label"), F.array(F.lit("lines.cs")).alias("entities"))
    config = MiningConfig(unit_history_window=0)
    return mining.pair_counts(units.unit_transactions(tx, u, config))


@query(
    f"WITH {ORDUNIT}, sized AS (SELECT seq, count(*) FILTER (WHERE changed) AS n, string_agg(unit || text, ',') AS x FROM (SELECT ch.*, '' AS text FROM ch) GROUP BY seq), "
    "a AS (SELECT seq, string_agg(unit || '=' || text, ',' ORDER BY unit) AS t FROM aft GROUP BY seq), b AS (SELECT seq, string_agg(unit || '=' || text, ',' ORDER BY unit) AS t FROM bef GROUP BY seq) "
    "SELECT seq, CASE WHEN a.t IS NULL OR b.t IS NULL THEN 'unknown' WHEN a.t = b.t THEN 'none' WHEN n = 0 THEN 'cosmetic' ELSE 'real' END AS kind FROM sized LEFT JOIN a USING (seq) LEFT JOIN b USING (seq)"
)
def edit_kinds_ordunit(spark, sf_dir):
    """X4."""
    u = _unit_versions(spark, sf_dir)
    whole = u.groupBy("seq", "side").agg(F.array_join(F.array_sort(F.collect_list(F.concat("unit_id", F.lit("="), "text"))), ",").alias("t"))
    side = lambda s: whole.where(F.col("side") == s).select("seq", F.col("t").alias(s))
    changed = units.changed_units(u).select("seq", F.size("units").alias("n"))
    joined = changed.join(side("before"), "seq", "left").join(side("after"), "seq", "left")
    return joined.select("seq", scoring.edit_kind("before", "after", "n").alias("kind"))


# ---- keeping up ---------------------------------------------------------------------------------------------------


@query(
    f"WITH {EV3D}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY seq DESC) AS r FROM events2), "
    "ex AS (SELECT entity_a, entity_b, string_agg(tx_id, ',' ORDER BY r) AS examples FROM ranked WHERE r <= 10 GROUP BY ALL) SELECT entity_a, entity_b, co, examples FROM pairs JOIN ex USING (entity_a, entity_b)"
)
def incremental_pairs_ev3d(spark, sf_dir):
    """The older half counted, the newer half merged in."""
    from basketwise.streaming.incremental import merge_pairs

    old, new, _ = baskets.holdout_split(ev3d(spark, sf_dir), 10**9)
    merged = merge_pairs(mining.pairs_with_examples(old), mining.pairs_with_examples(new.drop("k")), 10)
    return merged.select("entity_a", "entity_b", "co", F.array_join("examples", ",").alias("examples"))


@query(
    "SELECT o_custkey, count(*) AS changed FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS s, lag(o_orderkey) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) "
    "WHERE k IS NULL OR o_orderstatus <> s GROUP BY 1"
)
def changed_orders(spark, sf_dir):
    """orders of a customer whose status differs from the order before, or that have none before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("s", F.lag("o_orderstatus").over(w)).withColumn("p", F.lag("o_orderkey").over(w))
    current = o.select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("entity"), F.col("o_orderstatus").alias("hash"))
    base = o.where("p is not null").select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("entity"), F.col("s").alias("hash"))
    found = baskets.changed_since(base, current)
    return found.groupBy(F.split("entity", "/")[0].cast("long").alias("o_custkey")).agg(F.count(F.lit(1)).alias("changed"))


@query(
    f"WITH {CUSTNAT}, floors AS (SELECT tx_id AS change_set_id, greatest(0.3::DOUBLE, (seq % 10) / 10.0::DOUBLE) AS f FROM tx), "
    "cand AS (SELECT t.tx_id AS change_set_id, r.companion AS hole, r.confidence FROM touch t JOIN rules r ON r.trigger = t.entity JOIN floors ON floors.change_set_id = t.tx_id "
    "WHERE r.n >= 10 AND r.raw >= f AND NOT EXISTS (SELECT 1 FROM touch p WHERE p.seq = t.seq AND p.entity = r.companion)) SELECT change_set_id, hole, max(confidence) AS confidence FROM cand GROUP BY ALL"
)
def clamped_holes_custnat(spark, sf_dir):
    """every change set with a floor of its own, none below 0.3."""
    tx = custnat(spark, sf_dir)
    sets = tx.select(F.col("tx_id").alias("change_set_id"), (F.col("seq") % 10 / 10.0).alias("floor"), F.explode("entities").alias("entity"))
    return lookup.find_holes(_rules(tx), sets, scoring.clamp_floor("floor")).select("change_set_id", "hole", "confidence")


@query(f"WITH {CUSTNAT}, {ASKED} SELECT entity, CASE WHEN n_name IS NOT NULL THEN 'unit' ELSE 'entity' END AS level, coalesce(u.n, c.n, 0) AS n FROM (SELECT DISTINCT entity FROM sets) s LEFT JOIN counts c USING (entity) LEFT JOIN (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) u ON n_name = entity")
def routed_custnat(spark, sf_dir):
    """Nations known one level down (by their suppliers) are answered there."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return units.route_lookup(_asked_sets(spark, sf_dir).select("entity").distinct(), s, mining.entity_counts(custnat(spark, sf_dir)))
