"""Benchmark decontamination: rare seeds of words joined to the items that hold them, then Smith-Waterman alignment of words.

Every three words of a benchmark item, next to each other or with one left out, are a seed (fewer words where fewer are
a leak). One scan of the documents keeps those with a seed, as hashes of their words. How many hold each seed is counted from these.
A seed is rare where these documents times the items that hold it are few; common seeds go, but for the rarest one of every
stretch of an item that has the words a leak needs, so an exact copy of such a stretch always holds a seed that is kept,
however common its words are.

Documents are joined with the items by the seeds that are left. Each pair is then looked at whole: hits of all seeds of the
item, common ones too, that lie close together are one passage; the passage, with as many words around it as the item could
reach, is aligned with the item by Smith-Waterman over words, unless fewer of its words are the item's than a leak needs. A
leak is an aligned passage that is similar enough and covers enough of the item, or is long.

Documents are scanned once whatever the size of the benchmark. What is sent to the tasks is a Bloom filter of at most
32 * block_seeds bytes, built by Spark; the join tells hits from chance. Texts without a hit are never written or shuffled.
"""

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stash

U = np.uint64
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word sequences: (matches, item from, item to, passage from, passage to), ends
    exclusive; of equal scores, the one that ends first in the item and then in the passage. All 0 if nothing matches."""
    _, i, end_i, j, end_j, pairs = align_pairs(item, passage)
    return len(pairs), i, end_i, j, end_j


def align_pairs(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """The same as (score, item from, item to, passage from, passage to, matching places from the last to the first)."""
    n, m = len(item), len(passage)
    score = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m + 1) * -GAP
    for i in range(1, n + 1):
        pair = score[i - 1, :-1] + np.where(passage == item[i - 1], MATCH, MISMATCH)
        row = np.zeros(m + 1, np.int32)
        row[1:] = np.maximum(np.maximum(pair, score[i - 1, 1:] + GAP), 0)
        # a gap in the item: the best earlier cell of the row less the way to here
        score[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    if not score[i, j]:
        return 0, 0, 0, 0, 0, []
    end_i, end_j, best, pairs = int(i), int(j), int(score[i, j]), []
    while score[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            if same:
                pairs.append((int(i), int(j)))
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(i), end_i, int(j), end_j, pairs


def similar_part(pairs: list[tuple[int, int]], min_similarity: float) -> tuple[int, int, int, int, int]:
    """As align(): the part of an alignment with most matches that is similar enough, the first of these."""
    at = np.array(pairs[::-1], np.int64)
    n = len(at)
    for m in range(n, 0, -1):
        span = (at[m - 1 :] - at[: n - m + 1]).max(axis=1) + 1
        fits = np.flatnonzero(m >= min_similarity * span)
        if len(fits):
            (i0, j0), (i1, j1) = at[fits[0]].tolist(), at[fits[0] + m - 1].tolist()
            return m, i0, i1 + 1, j0, j1 + 1
    return 0, 0, 0, 0, 0


class Words:
    """Hashes of the words of a text: lower case, without marks at their edges; what is only marks is no word."""

    EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\u2018\u2019\u201c\u201d\u2026\u2014\u2013\u00ab\u00bb\u00a1\u00bf"

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if len(self.known) > 300_000:
            self.known = {}
        known = self.known
        for w in {w for w in words if w not in known}:
            bare = w.strip(self.EDGE)
            known[w] = xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        return h[h != 0]


def grams_of(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at these distances from every word; shapes never meet."""
    n = max(len(words) - shape[-1], 0)
    out = np.full(n, sum(1 << i for i in shape), U)
    for i in shape:
        out = out * U(0x9E3779B97F4A7C15) + words[i : i + n]
        out ^= out >> U(31)
    return out


class SeedTable:
    """Which of a few seeds are among very many grams: a table of bits first, then the sorted seeds."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = np.unique(seeds)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> U(42)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of the grams that are seeds."""
        at = np.flatnonzero(self.bits[(grams >> U(42)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0]
        found = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        return at[self.seeds[found] == grams[at]]


class SeedFilter:
    """A Bloom filter: one number of 64 bits for each seed, four of them set."""

    def __init__(self, places: np.ndarray, masks: np.ndarray, bits: int):
        self.shift, self.masks = U(64 - bits), np.zeros(1 << bits, U)
        self.masks[places] = masks

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of the grams that may be seeds, all seeds among them."""
        own = self.masks[(grams >> self.shift).astype(np.int64)]
        at = np.flatnonzero(own)
        mask = _mask_of(grams[at])
        return at[own[at] & mask == mask]


def _mask_of(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), U)
    for i in range(4):
        out |= U(1) << (grams >> U(6 * i) & U(63))
    return out


def seed_filter(seeds: DataFrame, block_seeds: int) -> SeedFilter:
    """The filter of seeds(gram). It has room for block_seeds seeds at most; with more of them it lets more pass."""
    once = seeds.select("gram").distinct()
    bits = (4 * max(1, min(once.count(), block_seeds)) - 1).bit_length()
    mask = reduce(Column.bitwiseOR, [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {6 * i}) & 63 as int))") for i in range(4)])
    table = once.groupBy(F.shiftrightunsigned("gram", 64 - bits).alias("at")).agg(F.bit_or(mask).alias("m")).toArrow()
    return SeedFilter(table["at"].to_numpy(), table["m"].to_numpy().view(U), bits)


LEAKS = "item_no long, matches long, item_from long, item_to long, item_words long, doc_from long, doc_to long, cover double, similarity double"


def least_matches(n: int, min_cover: float, long_match: int) -> int:
    """Matching words without which an alignment with an item of n words is no leak."""
    return max(1, min(math.ceil(min_cover * n - 1e-9), long_match))


def shapes_of(least: int) -> tuple[tuple[int, ...], ...]:
    """Seeds of an item: three words of which none or one inside is left out, fewer words where fewer are a leak."""
    return {1: ((0,),), 2: ((0, 1), (0, 2))}.get(least, ((0, 1, 2), (0, 1, 3), (0, 2, 3)))


def all_seeds(items: list[tuple], min_cover: float, long_match: int) -> dict:
    """shape -> seed -> [(number of item, place)], of every place of every item."""
    out: dict = defaultdict(lambda: defaultdict(list))
    for k, (_, words) in enumerate(items):
        for shape in shapes_of(least_matches(len(words), min_cover, long_match)):
            for at, g in enumerate(grams_of(words, shape).tolist()):
                out[shape][g].append((k, at))
    return {shape: dict(of) for shape, of in out.items()}


def passages(hits: list[tuple[int, int]], length: int, slack: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document's words to align, from hits (place in the document, place in the item).

    Hits further apart than the item and its slack are long belong to different passages.
    """
    part: list[tuple[int, int]] = []
    for hit in [*sorted(hits), None]:
        if part and (hit is None or hit[0] - part[-1][0] > length + slack):
            yield min(p - at for p, at in part) - slack, max(p + length - at for p, at in part) + slack
            part = []
        if hit:
            part.append(hit)


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 18) -> np.ndarray:
    """The best Smith-Waterman score of each (item, passage). Pairs of about one size are worked out side by side, a row
    of the tables at a time, so memory is a few times `cells` numbers or one row of the longest passage."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        m = int(len(pairs[order[at]][1]) * 1.25) + 8
        part = [k for k in order[at : at + max(1, cells // m)] if len(pairs[k][1]) <= m]
        at += len(part)
        part.sort(key=lambda k: -len(pairs[k][0]))
        sizes = np.array([len(pairs[k][0]) for k in part])
        # words are odd numbers: 0 and 2 stand for none
        items, texts = np.zeros((len(part), int(sizes[0])), U), np.full((len(part), m), U(2))
        for row, k in enumerate(part):
            items[row, : len(pairs[k][0])] = pairs[k][0]
            texts[row, : len(pairs[k][1])] = pairs[k][1]
        steps = np.arange(m + 1, dtype=np.int32) * -GAP
        above, best = np.zeros((len(part), m + 1), np.int32), np.zeros(len(part), np.int32)
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # items that have a word here stand first
            same = texts[:n] == items[:n, i : i + 1]
            row = np.zeros((n, m + 1), np.int32)
            row[:, 1:] = np.maximum(above[:n, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), above[:n, 1:] + GAP)
            np.maximum(row, 0, out=row)
            # a gap in the item: the best earlier cell of the row less the way to here
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)
            row -= steps
            above = row
            np.maximum(best[:n], row.max(axis=1), out=best[:n])
        out[part] = best
    return out


def leaks_in(texts: list[np.ndarray], items: list[tuple], seeds: dict, tables: dict, min_cover: float, min_similarity: float, long_match: int, wanted: list[set[int]] | None = None) -> list[list[tuple]]:
    """Rows of LEAKS of each document's words: for each item (of wanted ones, if given by document) the leak with most matches.
    Passages of all documents are scored side by side; only those that can be a leak by their score are aligned."""
    todo: list[tuple[int, int, int, int]] = []
    for d, own in enumerate(texts):
        by_item = defaultdict(set)
        for shape, table in tables.items():
            of, grams = seeds[shape], grams_of(own, shape)
            for pos in table.hits(grams).tolist():
                for k, at in of[int(grams[pos])]:
                    if wanted is None or k in wanted[d]:
                        by_item[k].add((pos, at))
        for k, hits in by_item.items():
            n = len(items[k][1])
            for a, b in passages(hits, n, 2 + int(n * (1 / min_similarity - 1))):
                # an alignment spans at most three times the item: longer stretches are cut into overlapping ones
                last = max(b - 4 * n, a) if b - a > 8 * n else a
                todo += [(d, k, i, min(i + 4 * n, b) if last > a else b) for i in (*range(a, last, n), last)]
    best: dict[tuple[int, int], tuple] = {}
    plain: dict[int, list[int]] = {d: texts[d].tolist() for d in {x[0] for x in todo}}
    while todo:
        likely = []
        for d, k, a, b in todo:
            a, b = max(a, 0), min(b, len(texts[d]))
            # no more words match than are the item's at all
            if sum(map(items[k][2].__contains__, plain[d][a:b])) >= least_matches(len(items[k][1]), min_cover, long_match):
                likely.append((d, k, a, b))
        scores = best_scores([(items[k][1], texts[d][a:b]) for d, k, a, b in likely])
        todo = []
        for (d, k, a, b), most in zip(likely, scores.tolist()):
            item, own = items[k][1], texts[d]
            n, least = len(item), least_matches(len(item), min_cover, long_match)
            # a leak loses at most a point for each word of either side that does not match
            if most < least * (MATCH - 2 * (1 / min_similarity - 1)) - 1e-9:
                continue
            _, i0, i1, j0, j1, pairs = align_pairs(item, own[a:b])
            m, wide = len(pairs), (a, a + j0, a + j1, b)
            if m < min_similarity * max(i1 - i0, j1 - j0):
                m, i0, i1, j0, j1 = similar_part(pairs, min_similarity)
            if m >= least:
                if (d, k) not in best or m > best[d, k][1]:
                    best[d, k] = (k, m, i0, i1, n, a + j0, a + j1, m / n, m / max(i1 - i0, j1 - j0))
            elif pairs:  # a long alignment that is no leak may hide a shorter one beside it
                todo += [(d, k, *wide[:2]), (d, k, *wide[2:])]
    out: list[list[tuple]] = [[] for _ in texts]
    for (d, _), row in best.items():
        out[d].append(row)
    return out


def leaks_of(own: np.ndarray, *how) -> list[tuple]:
    """leaks_in() of one document."""
    return leaks_in([own], *how)[0]


def _item_seeds(bench: DataFrame, min_cover: float, long_match: int) -> DataFrame:
    """no, first (whether the seed is of the item's first shape), at, gram of every seed of bench(no, words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(raw, U)
                for i, shape in enumerate(shapes_of(least_matches(len(words), min_cover, long_match))):
                    grams = grams_of(words, shape).view(np.int64)
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no)), pa.array(np.full(n, i == 0)), pa.array(np.arange(n)), pa.array(grams)], ["no", "first", "at", "gram"])

    return bench.select("no", "words").mapInArrow(cut, "no long, first boolean, at long, gram long")


def rare_places(at: np.ndarray, weight: np.ndarray, first: np.ndarray, words: int, limit: float) -> np.ndarray:
    """Which seeds of an item to keep: those of at most limit, and of those of the first shape the rarest ones of every
    `words` places next to each other, all that are equally rare."""
    keep = weight <= limit
    of = np.full(int(at.max()) + 1, np.inf)
    of[at[first]] = weight[first]
    words = min(words, len(of))
    least = np.lib.stride_tricks.sliding_window_view(of, words).min(axis=1)
    # the greatest of the least ones of all windows that a place is in
    around = np.full(len(of) + words - 1, -np.inf)
    around[words - 1 : words - 1 + len(least)] = least
    most = np.lib.stride_tricks.sliding_window_view(around, words).max(axis=1)
    return keep | first & (weight <= most[at])


def rare_seeds(seeds: DataFrame, bench: DataFrame, counts: DataFrame, limit: float, min_cover: float, long_match: int) -> DataFrame:
    """gram, no of those seeds(no, first, at, gram) of bench(no, words) to search for: those of which counts(gram, n) of documents
    times items are at most limit, and the rarest ones."""
    held = seeds.groupBy("gram").agg(F.countDistinct("no").alias("items"))
    weight = held.join(counts, "gram", "left").select("gram", (F.col("items") * F.coalesce("n", F.lit(0))).cast("double").alias("weight"))
    by_item = seeds.join(weight, "gram").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", "first", "weight", "gram"))).alias("seeds"))
    sized = by_item.join(bench.select("no", (F.octet_length("words") / 8).cast("long").alias("size")), "no")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, own, size in zip(*(c.to_pylist() for c in batch.columns)):
                least = least_matches(size, min_cover, long_match)
                at, first, weights, grams = (np.array([s[c] for s in own], kind) for c, kind in (("at", np.int64), ("first", bool), ("weight", float), ("gram", np.int64)))
                kept = np.unique(grams[rare_places(at, weights, first, least - shapes_of(least)[0][-1], limit)])
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(np.full(len(kept), no))], ["gram", "no"])

    return sized.select("no", "seeds", "size").mapInArrow(choose, "gram long, no long")


def seeds_in(texts: list[np.ndarray], seeds: SeedFilter, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The grams of each document's words that pass the filter, each once. Documents are looked at side by side."""
    ends = np.cumsum([len(t) for t in texts])
    words = np.concatenate(texts)
    doc, found = [], []
    for shape in shapes:
        grams = grams_of(words, shape)
        at = seeds.hits(grams)
        of = np.searchsorted(ends, at, "right")
        inside = at + shape[-1] < ends[of]  # a gram of one document only
        doc.append(of[inside])
        found.append(grams[at[inside]])
    doc, found = np.concatenate(doc), np.concatenate(found)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    doc, found = doc[new], found[new]
    return np.split(found, np.searchsorted(doc, np.arange(1, len(texts))))


def documents_with(docs: DataFrame, seeds: SeedFilter, shapes: list[tuple[int, ...]]) -> DataFrame:
    """k, words (hashes, eight bytes each) and grams (those that pass the filter, each once) of documents(k, t) that have any."""
    kind = docs.schema["k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            part, size, begin = [], 0, 0
            for place, t in enumerate(batch.column(1)):
                part.append(words(t.as_py()))
                size += len(part[-1])
                if size > 200_000 or place == batch.num_rows - 1:  # so many words are held at a time
                    own = [(begin + i, w.tobytes(), g.view(np.int64)) for i, (w, g) in enumerate(zip(part, seeds_in(part, seeds, shapes))) if len(g)]
                    places, texts, grams = zip(*own) if own else ((), (), ())
                    columns = [batch.column(0).take(pa.array(places, pa.int64())), pa.array(texts, pa.binary()), pa.array(grams, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "words", "grams"])
                    part, size, begin = [], 0, place + 1

    return docs.select("k", "t").mapInArrow(scan, f"k {kind}, words binary, grams array<long>")


def _leaks_of_pairs(pairs: DataFrame, min_cover: float, min_similarity: float, long_match: int) -> DataFrame:
    """k and LEAKS of pairs(k, words, items), items being (no, words) of the items to align with the row."""
    fields = [x.rsplit(" ", 1) for x in LEAKS.split(", ")]
    kind = pairs.schema["k"].dataType.simpleString()

    def aligned(rows: list[tuple[int, np.ndarray, dict]]) -> list[tuple]:
        known = {no: w for _, _, own in rows for no, w in own.items()}
        number = {no: i for i, no in enumerate(known)}
        items = [(no, w, set(w.tolist())) for no, w in known.items()]
        seeds = all_seeds([x[:2] for x in items], min_cover, long_match)
        tables = {shape: SeedTable(np.fromiter(of, U, len(of))) for shape, of in seeds.items()}
        wanted = [{number[no] for no in own} for _, _, own in rows]
        found = leaks_in([w for _, w, _ in rows], items, seeds, tables, min_cover, min_similarity, long_match, wanted)
        return [(place, items[k][0], *rest) for (place, _, _), own in zip(rows, found) for k, *rest in own]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows, size = [], [], 0
            for place in range(batch.num_rows):
                items = {x["no"]: np.frombuffer(x["words"], U) for x in batch.column(2)[place].as_py()}
                rows.append((place, np.frombuffer(batch.column(1)[place].as_py(), U), items))
                size += len(rows[-1][1])
                if size > 200_000 or place == batch.num_rows - 1:  # so many words are held at a time
                    out += aligned(rows)
                    rows, size = [], 0
            columns = [pa.array(c, pa.float64() if kind == "double" else pa.int64()) for c, (_, kind) in zip(list(zip(*out))[1:] if out else [[]] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), *columns], ["k", *(f for f, _ in fields)])

    return pairs.select("k", "words", "items").mapInArrow(scan, f"k {kind}, {LEAKS}")


def _item_words(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """no, i, words (hashes, eight bytes each) of every item that has words, as a stored table."""
    kind = items.schema[item_key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["i", "words"])

    own = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).mapInArrow(cut, f"i {kind}, words binary")
    return stash(own.where("octet_length(words) > 0").select(F.monotonically_increasing_id().alias("no"), "i", "words"), "leak-items")


def find_leaks(
    docs: DataFrame, items: DataFrame, min_cover: float = 0.4,
    min_similarity: float = 0.6, long_match: int = 25, block_seeds: int = 2_000_000, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", rare_share: float = 0.01, rare_docs: int = 100,
) -> DataFrame:
    """key, item_id, matches, item_from, item_to, item_words, doc_from, doc_to, cover, similarity per leak: the best
    passage of each row and item. Places count words, ends exclusive.

    cover: matching words over the item's words; similarity: matching words over the longer of the two aligned parts.
    A seed is rare if the documents times the items that hold it are at most rare_share of all documents, or rare_docs.
    Items and texts that are null or without words are in no leak. Of leaks of one item with equally many matches the
    first in the text is given. Repeated rows have results each; null keys are kept. Empty tables give an empty table.
    Texts of any length are searched whole; other columns are left out.
    """
    how = min_cover, min_similarity, long_match
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    bench = _item_words(items, item_key, item_text)
    seeds = stash(_item_seeds(bench, min_cover, long_match), "leak-seeds")
    # from some length on all items have the same shapes
    sizes = bench.select(F.least(F.octet_length("words") / 8, F.lit(math.ceil(3 / min_cover))).cast("int").alias("n")).distinct().collect()
    shapes = sorted({shape for r in sizes for shape in shapes_of(least_matches(r["n"], min_cover, long_match))}) or [(0,)]
    hit = documents_with(rows, seed_filter(seeds, block_seeds), shapes)
    hit = stash(hit.select(F.monotonically_increasing_id().alias("id"), "k", "words", "grams"), "leak-documents")
    each = hit.select("id", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    limit = max(float(rare_docs), rare_share * docs.count())
    rare = stash(rare_seeds(seeds, bench, counts, limit, min_cover, long_match), "leak-rare")
    met = each.join(rare, "gram").select("id", "no").distinct()
    # a list holds some 256 items, however many a document meets
    many = met.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / 256).alias("parts"))
    lists = met.join(many, "id").join(bench.select("no", "words"), "no").groupBy("id", F.pmod(F.xxhash64("no"), "parts").alias("part"))
    lists = lists.agg(F.collect_list(F.struct("no", "words")).alias("items")).select("id", "items")
    found = _leaks_of_pairs(hit.select("id", "k", "words").join(lists, "id"), *how)
    return found.join(bench.select(F.col("no").alias("item_no"), F.col("i").alias(item_key)), "item_no").select(
        F.col("k").alias(key), item_key, "matches", "item_from", "item_to", "item_words", "doc_from", "doc_to", "cover", "similarity"
    )


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text leaks an item; all columns kept, whatever their names. The search tells rows by
    a hash of the text, so null and repeated keys are safe; null and empty texts stay."""
    rows = docs.select(F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(1), F.col(text))).alias("id"), F.struct(*docs.columns).alias("row"))
    named = rows.select("id", F.col("row").getField(text).alias("text"))
    leaks = find_leaks(named, items, key="id", text="text", item_key=options.pop("item_key", "item_id"), **options).select("id").distinct()
    return rows.join(leaks, "id", "left_anti").select("row.*")
