"""Context-tree weighting over bytes: code length of whole texts under a model of the training documents.

A byte is coded by eight binary decisions; each decision (the bits of the byte so far) has a context tree over the
bytes before it, down to `depth`. Every node holds how often 0 and 1 followed; its Krichevsky-Trofimov estimate is mixed
half and half with the product of its children, so the weight of each depth follows from the counts alone. Counts don't
depend on the order of the documents, so the trees are built by merging counts, and the probability of a byte in its
context is one number for all its places in the corpus. A context not met in training is coded by the longest one that
was.

How Spark does it: texts fall into blocks of bounded size. Each block sends its distinct byte strings of length depth+1
(and its distinct words, for the word model) with their training counts, packed as arrays, to the bucket that owns
them: a bucket owns all contexts with the same two last bytes, so whole subtrees meet. Buckets merge, weigh and send
one number per string back to the block, which scores its texts. The two topmost depths are at most 256*255 nodes in
all, and are the only thing that passes through the driver. Nothing is broadcast that grows with the data.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import block_of, scanned, stash

U = np.uint64
LN2, LN10 = np.log(2.0), np.log(10.0)


def held_out(key) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 7, is 2 (a null id: of '')."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 == 2


def spelled(words: list[bytes]) -> bytes:
    """The bytes that are coded: words parted by one blank, and an end."""
    return b" ".join(words) + b"\0"


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the depth bytes before it as one number, text after text; and the number of bytes of each."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = len(data) - depth
    out = np.zeros(n, U)
    for i in range(depth + 1):
        out = (out << U(8)) | data[i : i + n]
    if len(texts) > 1:
        starts = np.cumsum(sizes + depth)[:-1] - depth
        real = np.ones(n, bool)
        for i in range(depth):
            real[starts + i] = False
        out = out[real]
    return out, sizes


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class BlockCounts:
    """Distinct strings and words of a block with their training counts (0: only in held-out texts)."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.words = depth, [], Counter()
        self.tokens = self.documents = 0
        self.waiting: dict[bool, list[bytes]] = {False: [], True: []}
        self.size = 0

    def add(self, key, text: str | None) -> None:
        words = (text or "").encode().lower().split()
        out = held_out(key)
        self.waiting[out].append(spelled(words))
        self.size += len(self.waiting[out][-1])
        if out:
            self.words.update(dict.fromkeys(words, 0))
        else:
            self.words.update(words)
            self.tokens += len(words) + 1
            self.documents += 1
        if self.size > 4_000_000:
            self.flush()

    def flush(self) -> None:
        for out, texts in self.waiting.items():
            if texts:
                keys, counts = np.unique(strings_of(texts, self.depth)[0], return_counts=True)
                self.parts.append((keys, counts * (not out)))
        self.waiting, self.size = {False: [], True: []}, 0
        if len(self.parts) > 8:
            self.strings()

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        if self.size:
            self.flush()
        if len(self.parts) != 1:
            none = [(np.zeros(0, U), np.zeros(0, np.int64))]
            self.parts = [_merge(*map(np.concatenate, zip(*(self.parts or none))))]
        return self.parts[0]

    def word_table(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U, len(self.words))
        return _merge(keys, np.fromiter(self.words.values(), np.int64, len(keys)))


def string_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """All strings with the same last two context bytes share a bucket."""
    return (((keys >> U(8)) & U(0xFFFF)) * U(0x9E3779B97F4A7C15) >> U(40)) % U(n)


def word_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> U(20)) % U(n)


def _parted(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in ascending order of key) for keys in ascending order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
    for a, b in zip(edge, [*edge[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


# ---- the trees of one bucket -------------------------------------------------------------------------------------


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function by Stirling's series, arguments lifted by 7."""
    product = np.ones_like(x)
    for i in range(7):
        product = product * (x + i)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(product)


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    a, b = a.astype(float), b.astype(float)
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1) - np.log(np.pi)


def mixed(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted probability (ln) of a node, and the weight of its own estimate."""
    w = np.logaddexp(kt, below) - LN2
    return w, np.exp(kt - LN2 - w)


def _decision(last: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a byte before its j-th, with a leading one; and the j-th bit."""
    return (last >> U(8 - j)) | U(1 << j), (last >> U(7 - j)) & U(1)


def _find(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(nodes, wanted), max(len(nodes) - 1, 0))
    return at, (nodes[at] == wanted if len(nodes) else np.zeros(len(wanted), bool))


def deep_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
    """Of one bucket: per key and decision the probability mixed over depths top..depth (nan: not met at depth top),
    and per node of depth top-1 what its children here add up to: (nodes, ln weighted, zeros, ones)."""
    met = counts > 0
    k, n = keys[met], counts[met]
    ctx, last = k >> U(8), k & U(255)
    parts = []
    for j in range(8):
        pre, bit = _decision(last, j)
        parts.append(((ctx << U(8)) | pre, n * (bit == 0), n * (bit == 1)))
    node = np.concatenate([p[0] for p in parts])
    zero, one = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    levels: dict[int, tuple] = {}
    weighted = None
    for d in range(depth, top - 2, -1):
        node = node & U((1 << 8 * (d + 1)) - 1)
        distinct, back = np.unique(node, return_inverse=True)
        zero, one = np.bincount(back, zero, len(distinct)), np.bincount(back, one, len(distinct))
        below = None if weighted is None else np.bincount(back, weighted, len(distinct))
        if d < top:
            summary = (distinct, below if below is not None else np.zeros(0), zero, one)
            break
        kt = ln_kt(zero, one)
        weighted, own = (kt, np.ones(len(kt))) if below is None else mixed(kt, below)
        levels[d] = (distinct, zero, one, own)
        node = distinct
    p = np.full((len(keys), 8), np.nan)
    ctx, last = keys >> U(8), keys & U(255)
    for j in range(8):
        pre, bit = _decision(last, j)
        for d in range(depth, top - 1, -1):
            distinct, zero, one, own = levels[d]
            at, found = _find(distinct, ((ctx & U((1 << 8 * d) - 1)) << U(8)) | pre)
            if not found.any():
                continue
            at, here = at[found], p[found, j]
            estimate = (np.where(bit[found] == 1, one[at], zero[at]) + 0.5) / (zero[at] + one[at] + 1)
            p[found, j] = np.where(np.isnan(here), estimate, own[at] * estimate + (1 - own[at]) * here)
    return p, summary


def word_answer(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> bytes:
    """The counts of the wanted words over all texts, 64 bits each."""
    return counts[np.searchsorted(keys, wanted)].astype(np.int64).tobytes()


SLICES = 16


def _slices(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of depth-1 nodes by slice, so that no task sums them all."""
    for i in range(SLICES):
        at = np.flatnonzero(node & U(SLICES - 1) == i)
        if len(at):
            yield i, at


def sum_nodes(table: pa.Table) -> pa.Table:
    """The partial sums of one slice's nodes, which every bucket below them has one of, added up."""
    parts = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]]) for c, kind in (("keys", U), ("below", float), ("zero", float), ("one", float))]
    node, back = np.unique(parts[0], return_inverse=True)
    sums = [np.bincount(back, v, len(node)) for v in parts[1:]]
    return pa.table({c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("keys", "below", "zero", "one"), (node, *sums))})


class TopNodes:
    """Depths 0 and 1: at most 255 and 256*255 nodes."""

    def __init__(self, summaries: list[tuple]):
        node, below, zero, one = (np.concatenate([s[i] for s in summaries] or [np.zeros(0)]) for i in range(4))
        self.node, back = np.unique(node.astype(U), return_inverse=True)
        add = lambda v, b, n: np.bincount(b, v, n)
        n = len(self.node)
        self.zero, self.one = add(zero, back, n), add(one, back, n)
        weighted, self.own = mixed(ln_kt(self.zero, self.one), add(below, back, n))
        self.root, back = np.unique(self.node & U(255), return_inverse=True)
        n = len(self.root)
        self.root_zero, self.root_one = add(self.zero, back, n), add(self.one, back, n)
        _, self.root_own = mixed(ln_kt(self.root_zero, self.root_one), add(weighted, back, n))

    def ln_probability(self, keys: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """ln of the probability of each key's last byte in its context."""
        out = np.zeros(len(keys))
        ctx, last = (keys >> U(8)) & U(255), keys & U(255)
        for j in range(8):
            pre, bit = _decision(last, j)
            p = deep[:, j].astype(float)
            for node, zero, one, own, wanted in (
                (self.node, self.zero, self.one, self.own, (ctx << U(8)) | pre),
                (self.root, self.root_zero, self.root_one, self.root_own, pre),
            ):
                if not len(node):
                    continue
                at, found = _find(node, wanted)
                estimate = (np.where(bit == 1, one[at], zero[at]) + 0.5) / (zero[at] + one[at] + 1)
                here = np.where(np.isnan(p), estimate, own[at] * estimate + (1 - own[at]) * p)
                p = np.where(found, here, p)
            out += np.log(np.where(np.isnan(p), 0.5, p))
        return out


class Lookup:
    """Values by key for very many keys: open addressing, looked up as whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.float32)
        taken = np.zeros(1 << self.bits, bool)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~taken[at]
            self.keys[at[free]] = keys[left[free]]
            taken[at[free]] = True
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.taken = taken

    def _slot(self, keys):
        return (keys * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            if not self.taken[at].all():
                raise KeyError("a string that its block has not sent")
            out[wrong] = self.values[at]
            off = self.keys[at] != keys[wrong]
            wrong, at = wrong[off], at[off]
        return out


# ---- Spark ------------------------------------------------------------------------------------------------------

SENT = "block string, kind string, bucket long, keys binary, counts binary, tokens long, documents long"
BACK = "block string, kind string, bucket long, vals binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def score_documents(
    docs: DataFrame, depth: int = 5, block_bytes: int = 16 << 20, buckets: int | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score: log10 probability of the text's words and end under the context trees; bits_per_byte: its code length for each
    byte that is coded (words, one blank between them, the end); base_score: the same under add-one
    word counts. Null or empty text: only the end is coded. Null keys train like the key ''. Repeated rows are separate
    training texts. If every document is held out, the trees are empty: each bit costs one bit, and every word is
    unknown. An empty table gives an empty table. Texts are used whole, whatever their length; further columns are left out.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    docs = scanned(docs.select(key, text), "ctw-texts")
    block = block_of(key, text, block_bytes)
    base = docs.select(block.alias("block"), F.col(key).alias("k"), F.col(text).alias("t"))
    spark = docs.sparkSession
    n = buckets or max(64, 2 * base.rdd.getNumPartitions())
    sent_schema, back_schema = _arrow(SENT), _arrow(BACK)

    def send(batches):
        blocks = defaultdict(lambda: BlockCounts(depth))
        for batch in batches:
            for b, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                blocks[b].add(k, t)
        for b, c in blocks.items():
            for kind, (keys, counts), part in (
                ("string", c.strings(), string_bucket), ("word", c.word_table(), word_bucket)
            ):
                for bucket, at in _parted(keys, part(keys, n)):
                    yield _batch([(b, kind, bucket, keys[at].tobytes(), counts[at].astype(np.uint32).tobytes(), 0, 0)], sent_schema)
            yield _batch([(b, "total", -1, b"", b"", c.tokens, c.documents)], sent_schema)

    sent = stash(base.mapInArrow(send, SENT), "ctw-sent")
    tokens, ends = sent.where("kind = 'total'").agg(F.sum("tokens"), F.sum("documents")).first()
    tokens, ends = tokens or 0, ends or 0

    def gathered(table: pa.Table):
        keys = [np.frombuffer(x.as_buffer(), U) for x in table["keys"]]
        counts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table["counts"]]
        return keys, _merge(np.concatenate(keys), np.concatenate(counts))

    made = "kind string, bucket long, block string, keys binary, vals binary, below binary, zero binary, one binary, known long"
    made_schema = _arrow(made)

    def build(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, bucket = (x.as_py() for x in group)
        sent_keys, (keys, counts) = gathered(table)
        if kind == "word":
            rows = [
                ("word", bucket, b, None, word_answer(keys, counts, k), None, None, None, 0)
                for b, k in zip(table["block"].to_pylist(), sent_keys)
            ]
            rows.append(("known", bucket, None, None, None, None, None, None, int((counts > 0).sum())))
        else:
            deep, (node, below, zero, one) = deep_probabilities(keys, counts, depth)
            rows = [
                ("deep", bucket, None, keys.tobytes(), deep.astype(np.float32).tobytes(), None, None, None, 0),
                *(("top", i, None, *(None if v is None else v[at].tobytes() for v in (node, None, below, zero, one)), 0) for i, at in _slices(node)),
            ]
        return pa.Table.from_batches([_batch(rows, made_schema)])

    built = stash(sent.where("kind <> 'total'").groupBy("kind", "bucket").applyInArrow(build, made), "ctw-built")
    known = built.agg(F.sum("known")).first()[0] or 0
    vocabulary = known + (ends > 0)
    arrays = lambda r: (np.frombuffer(r[0], U), *(np.frombuffer(x, float) for x in r[1:]))
    parts = built.where("kind = 'top'").select("bucket", "keys", "below", "zero", "one")
    summed = parts.groupBy("bucket").applyInArrow(sum_nodes, "keys binary, below binary, zero binary, one binary")
    top = TopNodes([arrays(r) for r in summed.collect()])  # 257*255 nodes at most

    def answer(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for own, deep in zip(right["keys"], right["vals"]):
            keys = np.frombuffer(own.as_buffer(), U)
            ln_p = top.ln_probability(keys, np.frombuffer(deep.as_buffer(), np.float32).reshape(-1, 8)).astype(np.float32)
            for b, k in zip(left["block"].to_pylist(), left["keys"]):
                wanted = np.frombuffer(k.as_buffer(), U)
                rows.append((b, "string", group[0].as_py(), ln_p[np.searchsorted(keys, wanted)].tobytes()))
        return pa.Table.from_batches([_batch(rows, back_schema)])

    strings = (
        sent.where("kind = 'string'").groupBy("bucket")
        .cogroup(built.where("kind = 'deep'").groupBy("bucket")).applyInArrow(answer, BACK)
    )
    back = strings.unionByName(built.where("kind = 'word'").select("block", "kind", "bucket", "vals"))
    result = "k string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    result_schema = _arrow(result)
    scale = np.log10(float(tokens + 1 * (vocabulary + 1)))

    def score(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ks = left["k"].to_pylist()
        c = BlockCounts(depth)
        texts, words = [], []
        for t in left["t"].to_pylist():
            own = (t or "").encode().lower().split()
            texts.append(spelled(own))
            words.append(own)
        index: dict[bytes, int] = {}
        ids = [np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own)) for own in words]
        word_keys = np.fromiter(map(xxhash.xxh3_64_intdigest, index), U, len(index))
        vals = defaultdict(dict)
        for kind, bucket, v in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["vals"]):
            vals[kind][bucket] = v.as_buffer()

        def spread(keys, bucket, kind, dtype):
            out = np.zeros(len(keys), dtype)
            for b, at in _parted(keys, bucket):
                out[at] = np.frombuffer(vals[kind][b], dtype)
            return out

        sorted_words = np.unique(word_keys)
        counts = spread(sorted_words, word_bucket(sorted_words, n), "word", np.int64)
        counts = counts[np.searchsorted(sorted_words, word_keys)].astype(float)
        logs, seen = np.log10(counts + 1) - scale, counts > 0
        end = np.log10(ends + 1.0) - scale
        chunks, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 4_000_000 or i == len(texts) - 1:
                chunks.append((at, i + 1))
                at, size = i + 1, 0
        uniques = [np.unique(strings_of(texts[a:b], depth)[0]) for a, b in chunks]
        keys = np.unique(np.concatenate(uniques))
        look = Lookup(keys, spread(keys, string_bucket(keys, n), "string", np.float32))
        scores, coded = [], []
        for a, b in chunks:
            strings, sizes = strings_of(texts[a:b], depth)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores.append(np.add.reduceat(look(strings).astype(float), starts) / LN10)
            coded.append(sizes)
        rows = list(zip(
            [None if k is None else str(k) for k in ks], map(held_out, ks), [len(w) + 1 for w in words],
            [int(seen[i].sum()) + (ends > 0) for i in ids], [tokens] * len(ks),
            [float(logs[i].sum() + end) for i in ids], np.concatenate(scores).tolist(),
            (-np.concatenate(scores) * np.log2(10) / np.concatenate(coded)).tolist(),
        ))
        return pa.Table.from_batches([_batch(rows, result_schema)])

    out = base.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, result)
    return out.withColumn(key, F.col("k").cast(docs.schema[key].dataType)).select(
        key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
