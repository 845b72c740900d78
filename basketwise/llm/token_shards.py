"""Token ids in binary shards with a minimal perfect hash index.

A shard is one self-describing blob: header, index, table of documents, payload of raw little-endian unsigned ids (16
bits if every id fits, else 32), one document after the other in ascending key order. Keys are placed level by level: each level is a bit array about 1.5 times as
large as the keys left, a key whose bit no other key hits is settled there, the rest go to the next level; the rank of
a key's bit is its slot. Every slot stores a 32-bit fingerprint of its key, the document's place and its length, so a
lookup touches a few bits and one slot, and tells a foreign key by the fingerprint. Null keys have a place in the
payload but no slot; a repeated key's slot names the first of its run of documents, which stand next to each other.

Spark writes the shards with its text writer (a binary column cast to string is written byte by byte), each in a file
of its own, so they land through the commit protocol in any file system Spark can write, and reads them back as
binaryFile. A shard's header holds the number of the task that wrote it and its number there, which give the order.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import stash

# fixed values of the file format
MAGIC = b"BWSHARD2"
HEAD = struct.Struct("<8sIIIIIIIQ")  # magic, task, shard of the task, bytes an id, documents, keys, levels, null keys, ids
GAMMA = 1.5
#: What str.split() takes for a blank beside " \t\n\r".
OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r"]
#: Marks that end a word in one piece, however many they are.
END_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts whose words are looked up at a time: few enough that they stay in the processor's cache.
TEXTS = 150
#: Words whose ids a worker keeps, in each of two generations.
KEPT = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + _MIX[:1] * np.uint64(seed + 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class KeyIndex:
    """Minimal perfect hash of distinct integer keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(b)]).astype(np.int64) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        levels, left = [], np.unique(keys)
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level settles it (then the key is foreign)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_hash(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.base[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list[int | None], ids: list[bytes], width: int = 4, task: int = 0, number: int = 0) -> bytes:
    """One shard, the number-th of a task, from documents in ascending key order, null keys first; ids come packed,
    width bytes each."""
    lengths = np.array([len(b) // width for b in ids], np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.uint64) if len(ids) else lengths
    known = np.array([k is not None for k in keys], bool)
    own = np.array([k for k in keys if k is not None], np.int64)
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    place = np.flatnonzero(known)[first]
    index = KeyIndex.build(own[first])
    slot = index.slots(own[first])
    marks = np.zeros(len(slot), np.uint32)
    marks[slot] = fingerprints(own[first])
    ordinal = np.zeros(len(slot), np.uint32)
    ordinal[slot] = place
    run = np.diff(np.concatenate([place, [len(keys)]])).astype(np.uint32)
    times = np.zeros(len(slot), np.uint32)
    times[slot] = run
    parts = [HEAD.pack(MAGIC, task, number, width, len(keys), len(slot), len(index.levels), int((~known).sum()), int(lengths.sum()))]
    for bits in index.levels:
        parts += [struct.pack("<I", len(bits)), np.packbits(bits).tobytes()]
    parts += [marks.tobytes(), ordinal.tobytes(), times.tobytes(), own.astype("<i8").tobytes()]
    parts += [starts.tobytes(), lengths.tobytes(), *ids]
    return b"".join(parts)


class Shard:
    """Keyed access to one packed shard; nothing but the header and index is unpacked."""

    def __init__(self, blob: memoryview, at: int = 0):
        magic, self.task, self.number, self.width, self.docs, n, levels, self.nulls, self.ids = HEAD.unpack_from(blob, at)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at += HEAD.size
        bits = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<I", blob, at)
            width = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at + 4), count=size).astype(bool))
            at += 4 + width

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.index = KeyIndex(bits)
        self.marks, self.ordinal, self.times = take("<u4", n), take("<u4", n), take("<u4", n)
        self.keys = take("<i8", self.docs - self.nulls)
        self.starts, self.lengths = take("<u8", self.docs), take("<u8", self.docs)
        self.blob, self.payload, self.end = blob, at, at + self.width * self.ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinal of the first document of each key, -1 for a foreign key; and how many documents it has."""
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.marks[slot[known]] == fingerprints(keys[known])
        slot = np.where(known, slot, 0)
        none = len(self.marks) == 0
        first = np.where(known, 0 if none else self.ordinal[slot].astype(np.int64), -1)
        return first, np.where(known, 0 if none else self.times[slot].astype(np.int64), 0)

    def read(self, ordinal: int) -> np.ndarray:
        """Ids of one document as unsigned 32-bit integers."""
        start = self.payload + self.width * int(self.starts[ordinal])
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(self.blob, kind, int(self.lengths[ordinal]), start).astype("<u4", copy=False)

    def places(self) -> np.ndarray:
        """Ordinal of every document, found by its key through the index; documents without a key come first."""
        distinct, at, times = np.unique(self.keys, return_index=True, return_counts=True)
        first, run = self.find(distinct)
        if (first < 0).any() or (run != times).any():
            raise ValueError("a key of the shard isn't in its index")
        within = np.arange(len(self.keys)) - np.repeat(at, times)
        return np.concatenate([np.arange(self.nulls), np.repeat(first, times) + within])


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once for each run of non-blanks.

    White space parts the pieces of such a vocabulary (its pattern never matches across), so the ids of a text are
    those of its words in a row; marks at the end of a run of letters are a piece of their own, if the letters are still
    letters once the library has normalised them (see plain). Words not yet known are encoded a batch at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to give out
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.blanks = re.compile("[ \t\n\r]+").split
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def plain(word: str) -> bool:
        """Whether it is letters only, of scripts whose letters no version of Unicode still changes, and stays so when
        composed and lowered: a letter may turn into a letter and a mark, which would join the mark after it."""
        if word.isascii():
            return word.isalpha()
        lowered = unicodedata.normalize("NFC", word).lower()
        return lowered.isalpha() and max(lowered) < "\u0530" and word.isalpha()

    def plain_of(self, words: Iterable[str]) -> set[str]:
        """Those of words that are plain; what needs no look at single letters is told first."""
        letters = set(filter(str.isalpha, words))
        found = set(filter(str.isascii, letters))
        found.update(filter(self.plain, letters - found))
        return found

    def ask(self, words: list[str]) -> None:
        for word, found in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
            self.kept[word] = struct.pack(f"<{len(ids := found.ids)}I", *ids)

    def ask_letters(self, words: list[str]) -> None:
        """Plain words are one piece each, and its last id tells where it ends: they are encoded in one text."""
        if not words:
            return
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return self.ask(words)
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.kept[word] = data[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        # the vocabulary is lower case; plain letters are lowered here already, so that fewer words differ
        cut = [self.blanks(t) if any(map(t.__contains__, OTHER_BLANKS)) else t.split() for t in (t.lower() if t.isascii() else t for t in texts)]
        if len(self.kept) > KEPT:
            self.kept, self.older = {}, self.kept
        known, older = self.kept, self.older
        new = set().union(*cut).difference(known)
        again = {w for w in new if w in older}
        for w in again:
            known[w] = older[w]
        new -= again
        letters = self.plain_of(new)
        marked = {w: head for w in new - letters if len(head := w.rstrip(END_MARKS)) < len(w)}
        before_mark = self.plain_of(marked.values())
        ends = [(w, head, w[len(head) :]) for w, head in marked.items() if head in before_mark]
        others = new.difference(letters, (w for w, _, _ in ends)) | {marks for _, _, marks in ends if marks not in known}
        self.ask_letters(list(letters | before_mark.difference(known)))
        self.ask(list(others))
        for w, head, marks in ends:
            known[w] = known[head] + known[marks]
        return [b"".join(map(known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
    width: int | None = None, shard_bytes: int = 16 << 20,
) -> None:
    """Encode whole texts and write them as shards in ascending key order, ids of width bytes (2 or 4; None: as many as
    the vocabulary and end_id need; an id that doesn't fit is an error).

    Null and empty texts are the end id alone. Null keys come first, repeated keys and rows stand next to each other in
    the order of a hash of their texts; rows equal in both keep their own places. Texts are encoded whole, one longer
    than a shard has a shard to itself. An empty table writes no shard. Other columns are left out.

    Keys are integers, as the files hold them in 64 bits; another type of column is a TypeError. Map other keys to numbers first.

    Texts are range-partitioned on the key (then a hash of the text, so that one key with very many documents is
    still parted) and encoded where they land; a task holds one shard at a time and rolls to the next at shard_bytes.
    """

    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is no column of integers")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        blobs: list = []
        size = number = 0
        encoder, tail, task = _encoder(vocabulary), struct.pack("<I", end_id), TaskContext.get().partitionId()
        highest = max(len(encoder.ends_word) - 1, end_id)
        size_of_id = width or (2 if highest < 1 << 16 else 4)
        if highest >= 1 << 8 * size_of_id:
            raise ValueError(f"ids of up to {highest} don't fit into {size_of_id} bytes")

        def out():
            return pa.RecordBatch.from_arrays([pa.array([pack_shard(keys, blobs, size_of_id, task, number)], pa.binary())], ["shard"])

        def encoded():
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                    yield from zip(part.column(0).to_pylist(), (b + tail for b in ids))

        for k, b in encoded():
            keys.append(k)
            blobs.append(b if size_of_id == 4 else np.frombuffer(b, "<u4").astype("<u2").tobytes())
            size += len(blobs[-1]) + 24
            if size >= shard_bytes:
                yield out()
                keys, blobs, size, number = [], [], 0, number + 1
        if keys:
            yield out()

    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = dealt.repartitionByRange(F.col("k"), F.col("h")).sortWithinPartitions("k", "h")
    dealt.select("k", "t").mapInArrow(pack, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _shards(spark: SparkSession, path: str, of_shard, schema: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                blob, at = memoryview(content.as_buffer()), 0
                while at < len(blob):
                    s = Shard(blob, at)
                    yield of_shard(s)
                    at = s.end + 1  # the text writer ends each shard with a newline

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, schema)


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32, by reading the files back.

    Every document is fetched by its key through its shard's index. Starts within a shard come from the shard; the ids
    before the shard from the totals of the shards of its task (a window by task) and of the tasks (one row a task).
    No shards: no rows. Null and repeated keys have a row for each document.
    """

    def documents(s: Shard) -> pa.RecordBatch:
        at = s.places()
        crc = [zlib.crc32(s.read(i)) for i in at.tolist()]
        keys = pa.array([None] * s.nulls + s.keys.tolist(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([s.task] * s.docs, pa.int64()), pa.array([s.number] * s.docs, pa.int64()), keys,
             pa.array(s.starts[at].astype(np.int64)), pa.array(s.lengths[at].astype(np.int64)),
             pa.array(crc, pa.int64())],
            ["task", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
        )

    rows = _shards(spark, path, documents, "task long, shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = stash(rows, "shard-documents")  # numbers only; the files are read once
    sums = rows.groupBy("task", "shard").agg(F.sum("n_tokens").alias("ids"))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_task = sums.groupBy("task").agg(F.sum("ids").alias("ids")).select("task", before(Window.orderBy("task")).alias("tasks_before"))
    base = sums.select("task", "shard", before(Window.partitionBy("task").orderBy("shard")).alias("shards_before")).join(of_task, "task")
    return rows.join(base, ["task", "shard"]).select(
        F.col("doc_id").alias(key), (F.col("tasks_before") + F.col("shards_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
