"""Exact copies by radix tries: texts are range-partitioned by adaptive prefixes, each partition inserts its whole texts into
one compressed trie whose terminals hold the least id, and a traversal of its rows tells which are copies.

What is cut before the shuffle: of equal texts in one batch only the rows with the least id go on, all others are known to
be copies. So a text that a third of all rows share reaches its partition once a batch, and the trie holds it once. The
bounds of the partitions come from all texts: every batch sorts its texts and names, every `grain` bytes, the shortest prefix
that parts two neighbours; running sums over these weighted prefixes give bounds about `partition_bytes` apart. What passes the driver
are those bounds, one prefix a partition.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.sources.running import running_sum


class Node:
    """An edge label, the children by their first byte, and the least id of the text that ends here."""

    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes, children: dict[int, Node] | None = None):
        self.label, self.children, self.least = label, children or {}, None


def common_length(a: bytes, b: bytes) -> int:
    """How many first bytes a and b share, by halving: compares whole slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed trie over bytes. insert() returns the node at which the text ends, with its least id brought up to date."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, key) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                k = common_length(child.label, text[at : at + len(child.label)])
                upper = Node(child.label[:k], {child.label[k]: child})
                child.label = child.label[k:]
                node.children[text[at]] = child = upper
                at += k
            node = child
        if node.least is None or key < node.least:
            node.least = key
        return node


def _separators(grain: int):
    """Batches of text to weighted prefixes (prefix, bytes): the bytes of the texts before the prefix and after the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, weights, before, held = [], [], b"", 0
            for text in sorted({*batch.column(0).cast(pa.binary()).to_pylist()}):
                if held >= grain:
                    prefixes.append(text[: common_length(before, text) + 1])
                    weights.append(held)
                    held = 0
                held += len(text) + 64
                before = text
            prefixes.append(b"")  # what is left counts at the front: its place doesn't matter, it is under the grain
            weights.append(held)
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.binary()), pa.array(weights, pa.int64())], ["prefix", "weight"])

    return run


def partition_bounds(texts: DataFrame, partition_bytes: int, grain: int) -> list[bytes]:
    """Rising prefixes that part the texts (one column, no nulls) into ranges of about partition_bytes."""
    weighted = texts.mapInArrow(_separators(grain), "prefix binary, weight long")
    merged = weighted.groupBy("prefix").agg(F.sum("weight").alias("weight"))
    summed = running_sum(merged, ["prefix"], "weight", "upto")
    cut = F.floor(F.col("upto") / partition_bytes) > F.floor((F.col("upto") - F.col("weight")) / partition_bytes)
    return sorted(bytes(r[0]) for r in summed.where(cut & (F.col("prefix") != F.lit(b""))).select("prefix").collect())  # one a partition


def _route(bounds, rest: Sequence[str]):
    """Rows (id, text, rest..) with the verdict where the batch alone tells it, the text where it doesn't, and the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, turn = bounds.value, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            least: dict[bytes, object] = {}
            for i, t in zip(ids, texts, strict=True):
                if i is not None and (t not in least or i < least[t]):
                    least[t] = i
            copy, sent, dest = [], [], []
            for i, t in zip(ids, texts, strict=True):
                known = i is None or least[t] < i
                copy.append((i is not None) if known else None)
                sent.append(None if known else t)
                dest.append(turn if known else bisect.bisect_right(edges, t))
                turn = (turn + 1) % (len(edges) + 1)
            arrays = [batch.column(0), pa.array(sent, pa.binary()), pa.array(copy, pa.bool_()), pa.array(dest, pa.int32()), *[batch.column(c) for c in rest]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "copy", "dest", *rest])

    return run


def _flag(rest: Sequence[str]):
    """The rows of one partition through one trie; rows keep their terminal, the texts stay in the trie only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kept = Trie(), []
        for batch in batches:
            ids, texts, known = batch.column("id"), batch.column("text"), batch.column("copy")
            ends = [None if t is None else trie.insert(t, i) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
            narrow = pa.RecordBatch.from_arrays([ids, known, *[batch.column(c) for c in rest]], ["id", "copy", *rest])
            if any(e is not None for e in ends):
                kept.append((narrow, ends))
            else:
                yield narrow
        for narrow, ends in kept:
            ids = narrow.column("id").to_pylist()
            flags = pa.array([None if e is None else e.least < i for e, i in zip(ends, ids, strict=True)], pa.bool_())
            arrays = [narrow.column("id"), pc.coalesce(flags, narrow.column("copy")), *[narrow.column(c) for c in rest]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "copy", *rest])

    return run


def flag_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rest: Sequence[str] = (), flag: str = "is_copy",
    partition_bytes: int = 32 << 20, grain: int = 128 << 10,
) -> DataFrame:
    """key, rest.. and `flag`: whether a row with a smaller key has the identical text; one row for each row of docs.

    A null text is the empty one. A row with a null key is no copy and makes none. Rows that repeat a key are no copies of
    each other by that key. Texts are compared whole, whatever their length; a partition holds partition_bytes of texts, or one
    text with what shares its bounds' prefix. An empty table gives no rows. Names inside don't meet the table's.
    """
    spark = docs.sparkSession
    own = [f"_r{i}" for i in range(len(rest))]
    whole = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), *[F.col(c).alias(o) for c, o in zip(rest, own, strict=True)])
    bounds = partition_bounds(whole.select("_t"), partition_bytes, grain)
    sent = spark.sparkContext.broadcast(bounds)  # one prefix a partition
    kind, carried = docs.schema[key].dataType.simpleString(), "".join(f", {o} {whole.schema[o].dataType.simpleString()}" for o in own)
    routed = whole.mapInArrow(_route(sent, own), f"id {kind}, text binary, copy boolean, dest int{carried}")
    dealt = routed.repartitionById(len(bounds) + 1, "dest")
    out = dealt.mapInArrow(_flag(own), f"id {kind}, copy boolean{carried}")
    return out.select(F.col("id").alias(key), *[F.col(o).alias(c) for o, c in zip(own, rest, strict=True)], F.col("copy").alias(flag))
