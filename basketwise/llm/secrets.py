"""Secret scans: strong patterns everywhere, weak candidates only where complementary parts stand together.

All native: patterns, lengths and arrays are built-in functions. The spans of a pattern come from cutting the text at
its matches: pieces and matches alternate, so running sums of their lengths, as rows, give every start and end. Parts (access
identifiers, secrets, endpoints) of a document become rows of one shuffle keyed by the row. The interval join needs no
pairs: of the parts that start no later than this one the latest end tells whether one stands near before it, of those
that start no earlier the first start tells whether one stands near after it, for each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the contract: the three base patterns and their least lengths
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGN, MIN_ACCESS = 8, 16

# weak patterns of our own: identifiers, high-variety strings and places to log in to
USER = r"""(?i:\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
# a run is tried once, from its start, so long runs cost no more than their length
KEY = r"(?<![A-Za-z0-9+/_])(?=[A-Za-z0-9+/_]*[0-9])(?=[A-Za-z0-9+/_]*[a-z])(?=[A-Za-z0-9+/_]*[A-Z])[A-Za-z0-9+/_]{20,}"
PLACE = r"""(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]+://[^\s"'<>]{4,}|(?i:\b(?:host|endpoint|server|url|bucket))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,})"""

KINDS = ("assign", "access", "hex", "user", "key", "place")
BASE = KINDS[:3]
#: What each kind can stand for; a weak one is reported only next to parts of the other sides.
SIDES = {"access": "id", "user": "id", "assign": "secret", "hex": "secret", "key": "secret", "place": "place"}
CUT = "array<struct<k:int,i:int,gap:int,m:int,g:int>>"


def cut_at(text: Column, pattern: str, kind: str) -> Column:
    """Array of (k, i, gap, m, g), one for each leftmost non-overlapping match: its number, and the lengths of what stands between it and
    the match before, of the match and of its group. Lengths only, so a text with very many matches costs no more than in proportion."""
    k = KINDS.index(kind)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    group = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length) if kind == "assign" else found
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"), group.alias("g"))
    numbered = F.transform(rows, lambda r, i: F.struct(F.lit(k).alias("k"), i.alias("i"), r["gap"].alias("gap"), r["m"].alias("m"), r["g"].alias("g")))
    return F.when(text.rlike(pattern), numbered).otherwise(F.array().cast(CUT))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda r: F.struct(r["s"].alias("s"), r["k"].alias("k"), r["e"].alias("e")))),
            lambda r: F.concat_ws(":", F.element_at(names, r["k"] + 1), r["s"].cast("string"), r["e"].cast("string")),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, scope: int = 300, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex, base_sha256, spans, links.

    links tells which reported parts belong together: set:kind:start:end of every part in a set of two sides or three, where a set is a
    run of parts each of which starts at most `scope` after the latest end before it.

    A weak part (user, key, place) with parts of both other sides at most `scope` characters away (from the end of the
    one to the start of the other, overlapping ones at 0) is reported, and so is a weak identifier or key that near to a
    part of the opposite side whose base pattern matched; not if it starts inside a base span. Null or empty text: no
    spans (base_sha256 of the empty string). Texts of any length are searched whole. Repeated rows and null keys keep
    their own rows, parted by a row number given at the scan; an empty table stays empty; further columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, USER, KEY, PLACE)))
    cuts = F.concat(*[cut_at(F.col("_t"), p, kind) for kind, p in patterns.items()])
    rows = docs.select(F.col(key).alias("_k"), body.alias("_t")).select("_k", cuts.alias("cuts"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # one part at the head of each row, so that rows without matches stay
    head = F.struct(*[F.lit(-1).alias(c) for c in ("k", "i", "gap", "m", "g")])
    parts = rows.select("row", "_k", F.explode(F.concat(F.array(head), "cuts")).alias("p")).select("row", "_k", "p.*").repartition("row")
    ends = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("e", F.when(F.col("k") < 0, -1).otherwise(ends).cast("int"))
    parts = parts.withColumn("s", F.when(F.col("k") < 0, -1).otherwise(F.col("e") - F.col("m")))
    least = F.when(F.col("k") == KINDS.index("assign"), MIN_ASSIGN).when(F.col("k") == KINDS.index("access"), MIN_ACCESS).otherwise(-1)
    parts = parts.where(F.col("g") >= least).select("row", "_k", "s", "e", "k")
    so_far = Window.partitionBy("row").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy("row").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)
    side = F.element_at(F.array(*[F.lit(SIDES[k]) for k in KINDS]), F.when(F.col("k") >= 0, F.col("k") + 1).otherwise(1))
    real = F.col("k") >= 0

    def near(which):
        before = F.max(F.when(real & which, F.col("e"))).over(so_far) >= F.col("s") - scope
        after = F.min(F.when(real & which, F.col("s"))).over(from_here) <= F.col("e") + scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    has = lambda what: near(F.col("side") == what)
    strong = lambda what: near((F.col("side") == what) & (F.col("k") < len(BASE)))
    seen = parts.withColumn("side", side).select(
        "*", has("id").alias("id"), has("secret").alias("sec"), has("place").alias("pl"),
        strong("id").alias("sid"), strong("secret").alias("ssec"),
    )
    inside = F.max(F.when(real & (F.col("k") < len(BASE)), F.col("e"))).over(
        Window.partitionBy("row").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    )
    linked = (F.col("id") & F.col("sec") & F.col("pl")) | F.when(F.col("side") == "id", F.col("ssec")).when(
        F.col("side") == "secret", F.col("sid")
    ).otherwise(F.lit(False))
    reported = seen.withColumn("covered", F.coalesce(inside, F.lit(-1)) > F.col("s")).where(
        (F.col("k") < len(BASE)) | (linked & ~F.col("covered"))
    )
    # a set ends where nothing starts within the scope of what ended last
    upto = F.max("e").over(Window.partitionBy("row").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(real & ((upto < 0) | (F.col("s") > upto + scope)), 1).otherwise(0)
    reported = reported.withColumn("_o", opens).withColumn("set", F.sum("_o").over(Window.partitionBy("row").orderBy("s", "k"))).withColumn(
        "sides", F.size(F.collect_set(F.when(real, F.col("side"))).over(Window.partitionBy("row", "set")))
    )
    per = reported.groupBy("row").agg(
        F.first("_k").alias(key), F.collect_list(F.when(real, F.struct("s", "e", "k"))).alias("all"),
        F.collect_list(F.when(real & (F.col("sides") > 1), F.struct("set", "s", "k", "e"))).alias("sets"),
    )
    names = F.array(*map(F.lit, KINDS))
    linked = F.transform(F.array_sort("sets"), lambda r: F.concat_ws(":", r["set"].cast("string"), F.element_at(names, r["k"] + 1), r["s"].cast("string"), r["e"].cast("string")))
    base_only = F.filter("all", lambda r: r["k"] < len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda r: r["k"] == KINDS.index(kind))).cast("long")
    return per.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base_only), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.array_join(linked, ",").alias("links"),
    )
