"""Spelling variants: words one edit apart, each hung under its much more frequent neighbour.

Words are counted in bounded tables a task and summed by Spark. Every word then generates its edits as hashes, a whole batch of
words at a time, and asks blocked Bloom filters of the vocabulary, one for each length of word; only what the filters know is
spelled out and shuffled to an exact join with the vocabulary, which removes the false positives.

A pair of neighbours is generated once: by the longer word, which leaves out one letter, or by the word with the lesser letter at
the place where two of one length differ. So a word of length n asks about n deletions and n times the alphabet replacements.

The filters are cut into segments of SEGMENT blocks. Spark builds each segment in a task of its own from the keys that
fall in it, and a broadcast holds at most `filter_bytes` of them: a larger vocabulary takes several rounds, and every round asks
the edits whose segments it holds. Hashes choose which words are asked for, they never decide: the join compares words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import stash

# fixed values of the contract: letters of a word, which occurrences lose a letter, the least length, count and ratio
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE, MIN_LETTERS, MIN_COUNT, RATIO = 199, 6, 5, 5

#: A block of a filter: LANES words of 32 bits, one bit set in each; blocks of a segment, which one task builds.
LANES, SEGMENT = 8, 1 << 13
ODD = [2 * (i * 0x9E3779B1 % (1 << 31)) + 1 for i in range(1, LANES + 1)]
STEP = 0x9E3779B97F4A7C15
#: Edits that are looked at together.
TOGETHER = 1 << 20


# ---- words -----------------------------------------------------------------------------------------------------------


def words_of(doc_id: str, text: str) -> dict[str, int]:
    """The words of a text with their number; of some runs, chosen by a hash of document and run, one letter is lost."""
    runs: dict[str, int] = {}
    for run in LETTERS.findall(text.encode().lower().decode()):
        runs[run] = runs.get(run, 0) + 1
    out: dict[str, int] = {}
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] = out.get(run, 0) + n
    return out


def _counted(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= MIN_LETTERS:
                        held[word] = held.get(word, 0) + n
                if len(held) >= limit:
                    yield out()
                    held = {}
        yield out()

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT, table_words: int = 200_000) -> DataFrame:
    """word, n of all words with min_count occurrences. A task sums words in a table of table_words at most before they shuffle."""
    own = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    counted = own.mapInArrow(_counted(table_words), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- hashes and filters ----------------------------------------------------------------------------------------------


def powers(n: int) -> np.ndarray:
    """STEP to the power 0 .. n modulo 2^64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    np.cumprod(np.full(n, STEP, np.uint64), out=out[1:])
    return out


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits depend on all bits of h."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA3AAAC6F1B4E8F35)
    return h ^ (h >> np.uint64(32))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def lane_bit(keys: np.ndarray, lane: int) -> np.ndarray:
    low = keys.astype(np.uint32)
    return np.uint32(1) << ((low * np.uint32(ODD[lane])) >> np.uint32(27))


class Filters:
    """Segments of blocked Bloom filters: blocks by length, and where each segment held lies."""

    def __init__(self, blocks: dict[int, int], segments: dict[tuple[int, int], bytes]):
        self.blocks = {length: n for length, n in blocks.items() if any(k == length for k, _ in segments)}
        self.start = {length: np.full(-(-n // SEGMENT), -1, np.int64) for length, n in self.blocks.items()}
        at, parts = 0, []
        for (length, segment), data in segments.items():
            self.start[length][segment] = at
            parts.append(np.frombuffer(data, np.uint32).reshape(-1, LANES))
            at += len(parts[-1])
        self.bits = np.concatenate(parts) if parts else np.zeros((0, LANES), np.uint32)

    def known(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Which places of the flat array hashes may be words of that length: rising indices."""
        if length not in self.blocks:
            return np.zeros(0, np.int64)
        keys = spread(hashes)
        block = block_of(keys, self.blocks[length])
        start = self.start[length][block // SEGMENT]
        at = np.arange(len(keys))
        if (start < 0).any():
            at = np.flatnonzero(start >= 0)
            keys, block, start = keys[at], block[at], start[at]
        row = start + block % SEGMENT
        for lane in range(LANES):
            hit = (self.bits[row, lane] & lane_bit(keys, lane)) != 0
            at, keys, row = at[hit], keys[hit], row[hit]
        return at


def _filter_keys(blocks: dict[int, int]):
    """Words to (length, segment, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words, _ in _by_length(batch):
                keys = spread((code_points(words) * powers(length)[:length]).sum(1, dtype=np.uint64))
                segment = block_of(keys, blocks[length]) // SEGMENT
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), length), pa.int32()), pa.array(segment, pa.int32()), pa.array(keys.view(np.int64))], ["length", "segment", "key"]
                )

    return run


def _build(blocks: dict[int, int]):
    """The bits of one segment from its keys."""

    def run(table: pa.Table) -> pa.Table:
        length, segment = table.column("length")[0].as_py(), table.column("segment")[0].as_py()
        size = min(SEGMENT, blocks[length] - segment * SEGMENT)
        bits = np.zeros((size, LANES), np.uint32)
        keys = table.column("key").to_numpy().view(np.uint64)
        row = block_of(keys, blocks[length]) - segment * SEGMENT
        for lane in range(LANES):
            np.bitwise_or.at(bits[:, lane], row, lane_bit(keys, lane))
        return pa.table({"length": pa.array([length], pa.int32()), "segment": pa.array([segment], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def _by_length(batch: pa.RecordBatch):
    """(length, words, n) of a batch of (word, n)."""
    words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    parts: dict[int, tuple[list, list]] = {}
    for w, k in zip(words, n, strict=True):
        p = parts.setdefault(len(w), ([], []))
        p[0].append(w)
        p[1].append(k)
    return [(length, *p) for length, p in sorted(parts.items())]


# ---- edits -----------------------------------------------------------------------------------------------------------


def known_edits(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """(index of a word, edit) of words of one length: each deletion and each replacement by a greater letter that the filters know."""
    length = len(words[0])
    power = powers(length)
    rows = max(1, min(len(words), TOGETHER // (length * len(alphabet))))
    places = max(1, TOGETHER // len(alphabet)) if rows == 1 else length  # one very long word is looked at in pieces
    back = pow(STEP, -1, 1 << 64)
    for low in range(0, len(words), rows):
        own = words[low : low + rows]
        c = code_points(own)
        parts = c * power[:length]
        whole = parts.sum(1, dtype=np.uint64)
        if length - 1 in filters.blocks:
            upto = np.cumsum(parts, axis=1, dtype=np.uint64)
            without = (upto - parts) + (whole[:, None] - upto) * np.uint64(back)
            first = np.ones(c.shape, bool)  # a letter left out of a run of equal ones gives one word only
            first[:, 1:] = c[:, 1:] != c[:, :-1]
            asked = np.flatnonzero(first)
            for k in asked[filters.known(length - 1, without.ravel()[asked])]:
                i, at = divmod(int(k), length)
                yield low + i, own[i][:at] + own[i][at + 1 :]
        if length in filters.blocks:
            for start in range(0, length, places):
                piece = c[:, start : start + places]
                step = alphabet[None, None, :] - piece[:, :, None]
                edited = whole[:, None, None] + step * power[start : start + piece.shape[1]][None, :, None]
                asked = np.flatnonzero((alphabet[None, None, :] > piece[:, :, None]).ravel())
                for k in asked[filters.known(length, edited.ravel()[asked])]:
                    i, rest = divmod(int(k), piece.shape[1] * len(alphabet))
                    at, letter = divmod(rest, len(alphabet))
                    at += start
                    yield low + i, own[i][:at] + chr(int(alphabet[letter])) + own[i][at + 1 :]


def _asked(alphabet: np.ndarray, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, counts in _by_length(batch):
                found = [*known_edits(words, alphabet, filters.value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i, _ in found], pa.string()), pa.array([counts[i] for i, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())],
                    ["word", "n", "edit"],
                )

    return run


def near_pairs(words: DataFrame, filter_bytes: int = 64 << 20, bits: int = 16) -> DataFrame:
    """a, n_a, b, n_b: every two words(word, n) one edit apart, once. bits of a filter for each word; the filters that are held at
    once take filter_bytes at most."""
    spark: SparkSession = words.sparkSession
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}  # one row a length of word
    blocks = {length: -(-n * bits // (32 * LANES)) for length, n in sizes.items()}
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint64)  # at most 90 letters
    out = spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    if not sizes:
        return out
    keys = words.mapInArrow(_filter_keys(blocks), "length int, segment int, key long")
    built = stash(keys.groupBy("length", "segment").applyInArrow(_build(blocks), "length int, segment int, bits binary"), "filters")
    every = [(length, s, min(SEGMENT, n - s * SEGMENT) * LANES * 4) for length, n in sorted(blocks.items()) for s in range(-(-n // SEGMENT))]
    rounds, room = [], 0
    for length, s, size in every:
        if not rounds or room + size > filter_bytes:
            rounds.append([])
            room = 0
        rounds[-1].append((length, s))
        room += size
    for own in rounds:
        low, high = own[0], own[-1]  # segments are taken in order
        at = F.struct("length", "segment")
        rows = built.where(at.between(F.struct(F.lit(low[0]), F.lit(low[1])), F.struct(F.lit(high[0]), F.lit(high[1])))).collect()  # within filter_bytes
        held = spark.sparkContext.broadcast(Filters(blocks, {(r["length"], r["segment"]): bytes(r["bits"]) for r in rows}))
        near = F.length("word").between(low[0], high[0] + 1)
        asked = words.where(near).mapInArrow(_asked(alphabet, held), "word string, n long, edit string")
        known = words.select(F.col("word").alias("edit"), F.col("n").alias("n_b"))
        out = out.union(asked.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"), "n_b"))
    return out


# ---- forms -----------------------------------------------------------------------------------------------------------


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    form is the near word with the largest n (ties: the least in code-point order), if that is ratio times the word's own at
    least; root is the last word that forms lead to. Null and empty texts have no words; a null key counts as the empty string
    where letters are lost. Rows that repeat count each time. An empty table, or one without such words, gives no rows.
    """
    words = vocabulary(docs, key, text, min_count)
    words = stash(words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "words")  # work is by word, not by byte
    pairs = stash(near_pairs(words, **how), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    formed = stash(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")),
        "formed",
    )
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    # each step along forms multiplies n by the ratio at least, so chains are short; each round doubles what a word looks ahead
    steps = max(1, math.ceil(math.log(most, ratio))) if ratio > 1 else most
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots = stash(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
