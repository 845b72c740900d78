"""Near-duplicate classes of documents: ProbMinHash of weighted word shingles, banding, exact verification.

ProbMinHash: every distinct shingle starts a Poisson process with its count as rate; each arrival falls on one of the
signature's places and takes it if nothing came earlier. A shingle stops once its next arrival is later than the latest
of all places, so most shingles need one or two arrivals. The share of equal places estimates the probability Jaccard
similarity. Bands of places are hashed into buckets. Links are verified by the similarity of distinct shingles, so a
text that repeats some also enters the buckets of its sketch with every weight 1.

Equal texts are merged first. In a bucket every text is linked to the bucket's first one, which gives families:
everything that could be similar lies in one family, at one row a text and bucket. Every text of a family is then compared
with the family's first one, which settles families of copies at one row a text. What is not linked to it is apart: texts
apart are dealt into blocks of bounded size, and so are the others of their family; each block of texts apart meets each
other block in one task's group, which returns only the links that join what was not yet joined there. Classes are the
connected groups of those links, so no link between different texts is lost, no group gathers a whole family and no list of
pairs is ever written. Rows grow with a family's texts times its blocks of texts apart.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import connected_groups, stash

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
HASH_BITS = 44


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles_of(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts as (document, 44-bit hash, count), ordered by document and hash.

    Words are runs of non-blanks in lower case. A text of fewer words than the width has one shingle of them all; one
    without words has none. At most 2**20 texts at a time.
    """
    import xxhash

    words = [t.lower().split() for t in texts]
    table: dict[str, int] = {}
    for w in words:
        for x in w:
            if x not in table:
                table[x] = xxhash.xxh3_64_intdigest(x)
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((table[x] for w in words for x in w), U, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    starts = np.cumsum(sizes) - sizes
    n = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    first = np.arange(len(h)) - starts[doc] < n[doc]
    at = np.flatnonzero(first)
    last = (starts + sizes)[doc[at]]
    out = np.zeros(len(at), U)
    for i in range(width):
        place = np.minimum(at + i, len(h) - 1)
        out = _mix(out + np.where(at + i < last, h[place], U(1)) * MULT + U(i))
    keys = (doc[at].astype(U) << U(HASH_BITS)) | (out >> U(64 - HASH_BITS))
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> U(HASH_BITS)).astype(np.int64), keys & U((1 << HASH_BITS) - 1), counts


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, places: int) -> np.ndarray:
    """Signatures of n documents (places each); 0 everywhere for a document without shingles."""
    arrival = np.full(n * places, np.inf)
    holder = np.zeros(n * places, U)
    active = np.arange(len(doc))
    time = np.zeros(len(doc))
    turn = 0
    while len(active):
        e = shingle[active]
        r = _mix(e * MULT + U(2 * turn + 1))
        u = ((r >> U(11)).astype(float) + 0.5) / 9007199254740992.0
        t = time[active] - np.log(u) / weight[active]
        time[active] = t
        place = doc[active] * places + (_mix(e + U(int(MULT) * (2 * turn + 2) % (1 << 64))) % U(places)).astype(np.int64)
        wins = np.flatnonzero(t < arrival[place])
        wins = wins[np.argsort(-t[wins], kind="stable")]  # the earliest is written last
        arrival[place[wins]] = t[wins]
        holder[place[wins]] = e[wins] + U(1)
        latest = arrival.reshape(n, places).max(axis=1)
        active = active[t < latest[doc[active]]]
        turn += 1
    return holder.reshape(n, places)


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    n, places = signatures.shape
    rows = places // bands
    out = np.tile(np.arange(1, bands + 1, dtype=U) * MULT, (n, 1))
    for i in range(rows):
        out = _mix(out + signatures[:, i::rows][:, :bands] * MULT)
    return out.view(np.int64)


def all_bands(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, bands: int, rows: int) -> list[list[int]]:
    """Bands of n documents: by counts, and, where a shingle is repeated, also with every weight 1. Without repeats both
    are the same."""
    out = band_hashes(prob_minhash(doc, shingle, count.astype(float), n, bands * rows), bands).tolist()
    again = np.unique(doc[count > 1])
    if len(again):
        own = np.isin(doc, again)
        place = np.searchsorted(again, doc[own])
        plain = prob_minhash(place, shingle[own], np.ones(len(place)), len(again), bands * rows)
        for i, b in zip(again.tolist(), band_hashes(plain, bands).tolist()):
            out[i] += b
    return out


def _slices(texts: list[str], limit: int = 1_500_000):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def bands_column(text, width: int, bands: int, rows: int):
    """array<bigint> of band hashes, by counts and by distinct shingles; empty for a text without words."""

    @F.arrow_udf("array<bigint>")
    def banded(column: pa.Array) -> pa.Array:
        texts = [t.as_py() or "" for t in column]
        out = []
        for a, b in _slices(texts):
            doc, e, c = shingles_of(texts[a:b], width)
            found = all_bands(doc, e, c, b - a, bands, rows)
            some = np.bincount(doc, minlength=b - a) > 0
            out += [f if s else [] for f, s in zip(found, some.tolist())]
        return pa.array(out, pa.list_(pa.int64()))

    return banded(text)


def shingles_column(text, width: int):
    """Binary column of the ascending distinct shingle hashes (unsigned 64-bit)."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        texts = [t.as_py() or "" for t in column]
        out = []
        for a, b in _slices(texts):
            doc, e, _ = shingles_of(texts[a:b], width)
            edge = np.searchsorted(doc, np.arange(b - a + 1))
            out += [e[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
        return pa.array(out, pa.binary())

    return packed(text)


def similar_column(s, other, similarity: float):
    """Whether two packed sets have at least that Jaccard similarity."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):
            x, y = (np.frombuffer(c.as_buffer(), U) for c in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else -1
            out.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
        return pa.array(out, pa.bool_())

    return similar(s, other)


def spanning_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) of Jaccard similarity at least that, enough to join all that such links join.

    side: with two values, only rows of different sides are compared; with one, all rows are.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    starts = np.cumsum(size) - size
    width = int(column.max()) + 1
    group = np.arange(n)
    crossing = len(np.unique(side)) > 1
    out = []
    for i in np.argsort(-size, kind="stable"):
        rest = (group != group[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
        if crossing:
            rest &= side != side[i]
        if not rest.any():
            continue
        mark = np.zeros(width, bool)
        mark[column[starts[i] : starts[i] + size[i]]] = True
        inside = rest[owner]
        common = np.bincount(owner[inside], mark[column[inside]], n)
        for j in np.flatnonzero(rest & (common >= similarity * (size + size[i] - common) - 1e-9)):
            if group[j] != group[i]:
                out.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return out


def near_classes(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5, block: int = 400,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """k, h1, h2, n_rows, class_id, first of every distinct (key, text): its class and whether it comes first in it.

    class_id is the smallest key of the class (null only if all its keys are). Texts without words are alone with equal
    texts' rows apart: each (key, text) is its own class.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("k"), body.alias("t")).select(
        "k", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t"
    )
    signed = base.select("k", "h1", "h2", bands_column(F.col("t"), width, bands, rows).alias("bands"))
    signed = stash(signed, "near-signed")
    texts = signed.where(F.size("bands") > 0).groupBy("h1", "h2").agg(
        F.min(F.struct("k")).alias("head"), F.first("bands").alias("bands")
    )
    texts = stash(texts.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    entries = texts.select(F.explode("bands").alias("key"), "id")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("b")).where("size > 1")
    star = entries.join(shared, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    families = connected_groups(star, "near-families")
    placed = families.join(texts.select(F.col("id").alias("node"), "h1", "h2", F.col("head.k").alias("k")), "node")
    # the text of one document for each: its first
    alike = (base["h1"] == F.col("p.h1")) & (base["h2"] == F.col("p.h2")) & base["k"].eqNullSafe(F.col("p.k"))
    held = base.join(placed.alias("p"), alike).select("node", "grp", F.col("t").alias("_t")).dropDuplicates(["node"])
    held = stash(held.select("node", "grp", shingles_column(F.col("_t"), width).alias("s")), "near-shingles")
    first = held.where("node = grp").select("grp", F.col("s").alias("first_s"))
    with_first = held.where("node <> grp").join(first, "grp").select("grp", "node", similar_column(F.col("s"), F.col("first_s"), similarity).alias("linked"))
    with_first = stash(with_first, "near-first-links")
    apart = with_first.where("not linked").groupBy("grp").agg(F.count(F.lit(1)).alias("apart"))
    sizes = families.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).join(apart, "grp").select(
        "grp", F.ceil(F.col("apart") / block).alias("rows"), F.ceil((F.col("size") - F.col("apart")) / block).alias("columns")
    )
    rest = held.join(sizes, "grp").join(with_first.select("node", "linked"), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(True)))
    # blocks of texts apart are numbered first, those of the others after them; two blocks meet if one is of texts apart
    own = F.when(F.col("linked"), F.col("rows") + F.pmod(F.xxhash64("node"), F.col("columns"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rows")))
    zero = F.lit(0).cast("long")
    others = F.when(F.col("linked"), F.sequence(zero, F.col("rows") - 1)).otherwise(F.sequence(zero, F.col("rows") + F.col("columns") - 1))
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "s")

    def compare(table: pa.Table) -> pa.Table:
        node, sets = table["node"].to_numpy(), [np.frombuffer(s.as_buffer(), U) for s in table["s"]]
        links = spanning_links(sets, table["own"].to_numpy(), similarity)
        a, b = ([int(node[x[i]]) for x in links] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = dealt.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")
    links = links.unionByName(with_first.where("linked").select(F.col("node").alias("a"), F.col("grp").alias("b")))
    groups = connected_groups(links, "near-groups")
    placed = texts.select("h1", "h2", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("h1", "h2", F.coalesce("grp", "id").alias("grp"))
    members = signed.groupBy("k", "h1", "h2").agg(F.count(F.lit(1)).alias("n_rows")).join(placed, ["h1", "h2"], "left")
    members = stash(members, "near-members")
    some = members.where("grp is not null")
    heads = some.groupBy("grp").agg(F.min("k").alias("class_id"), F.min(F.struct("k", "h1", "h2")).alias("at"))
    grouped = some.join(heads, "grp").select(
        "k", "h1", "h2", "n_rows", "class_id", (F.struct("k", "h1", "h2") == F.col("at")).alias("first")
    )
    return grouped.unionByName(
        members.where("grp is null").select("k", "h1", "h2", "n_rows", F.col("k").alias("class_id"), F.lit(True).alias("first"))
    )


def class_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, class_id, kept (true for one row of each class, the one of the smallest key).

    Null and empty texts are never near-duplicates of others. Rows equal in key and text are one class and count once
    in kept: their n_rows rows are told apart by copy, 0 for the first. Other columns are left out.
    """
    found = near_classes(docs, key=key, text=text, **options)
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    return copies.select(F.col("k").alias(key), "class_id", (F.col("first") & (F.col("copy") == 0)).alias("kept"), "copy")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class left, all columns kept, whatever their names. Null and empty texts are each a class
    of their own by key; of rows equal in key and text one stays, any of them. Texts of any length are compared whole; an
    empty table stays empty."""
    first = stash(near_classes(docs, key=key, text=text, **options).where("first").select("k", "h1", "h2", "n_rows"), "near-first")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    hashed = rows.select("row", F.col("row").getField(key).alias("key"), F.xxhash64(body).alias("x1"), F.xxhash64(F.lit(1), body).alias("x2"))
    at = F.col("key").eqNullSafe(F.col("k")) & (F.col("x1") == F.col("h1")) & (F.col("x2") == F.col("h2"))
    once = hashed.join(first.where("n_rows = 1"), at, "left_semi")
    again = hashed.join(first.where("n_rows > 1"), at, "left_semi").dropDuplicates(["x1", "x2", "key"])
    return once.unionByName(again).select("row.*")
