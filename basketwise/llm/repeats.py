"""Suffix-array style removal of repeated byte strings by bucket-pointer refinement, in distributed buckets.

Every place of a text starts in the bucket of its first eight bytes. A bucket is refined by the bucket identifiers of
later offsets: the identifier of 2q bytes at a place is made of those of q bytes at the place and at q places later,
and each refinement is reused by the next, up to the identifiers of `window` and of `length` bytes (two overlapping
ones of 256). Two places with the same identifier at full length start the same string.

Refining all places to full length across the corpus would send each of them over the network. Instead each string of
full length is first known by the least window identifier inside it; these, about two in a hundred places, are counted
over the corpus, with all that the strings of that window cover together: where that is the same wherever the window
occurs, all those strings are repeats and need no more. Only strings whose least window occurs twice in different
surroundings are refined to full length and counted. Both counts are made by buckets that each own a share of the identifiers: blocks of texts send packed identifiers, buckets send back one bit for
each. A string that a third of all texts hold is counted in its block first, so it reaches its bucket once a block; other
strings around it have identifiers of their own and other buckets.

The same first pass also counts the least windows of the strings of a shorter length, `report`; for these only the number
of bytes under strings whose window occurs again is given, without refinement to full length.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import block_of, scanned, stash

U = np.uint64


def _join(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifier of two adjoining (or overlapping) strings from theirs."""
    x = first * U(0x9E3779B97F4A7C15) + later
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def identifiers(data: bytes, *lengths: int) -> list[np.ndarray]:
    """Identifiers of the strings of each length (16 bytes or more) from every place of data that has one."""
    n, out, q = len(data), {}, 8
    at = np.ndarray(max(n - 7, 0), "<u8", data, strides=(1,)).astype(U)
    at = _join(at, at)
    while len(out) < len(set(lengths)):
        for size in lengths:
            if q <= size < 2 * q:
                out[size] = _join(at[: max(n - size + 1, 0)], at[size - q : max(size - q + n - size + 1, 0)])
        at = _join(at[:-q], at[q:])
        q *= 2
    return [out[size] for size in lengths]


def sliding(best: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """np.minimum or np.maximum of each w neighbours."""
    q = 1
    while 2 * q <= w:
        x = best(x[:-q], x[q:])
        q *= 2
    return best(x[: len(x) - (w - q)], x[w - q :]) if q < w else x


class Refined:
    """Texts put end to end: for each place that starts a string of full length inside its text, the least window
    identifier of the string; and the string's own identifier."""

    def __init__(self, sizes: np.ndarray, length: int, window: int, windows: np.ndarray, whole: np.ndarray):
        first = np.cumsum(sizes) - sizes
        runs = np.maximum(sizes - length + 1, 0)
        self.places = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
        self.owner = np.repeat(np.arange(len(sizes)), runs)
        self.offset = self.places - first[self.owner]
        self.first, self.spare, self.windows, self.whole = first, length - window, windows, whole
        if len(self.places):
            self.all_least = sliding(np.minimum, self.windows, self.spare + 1)
            self.least = self.all_least[self.places]
            new = np.concatenate([[True], (self.least[1:] != self.least[:-1]) | (self.owner[1:] != self.owner[:-1])])
            self.start = np.flatnonzero(new)
            self.size = np.diff(np.concatenate([self.start, [len(self.least)]]))
            self.mark = self.least[self.start]
        else:
            self.start = self.size = np.zeros(0, np.int64)
            self.mark = np.zeros(0, U)

    def contexts(self) -> np.ndarray:
        """For each run of strings with one mark, an identifier of all that they cover together."""
        both = _join(self.whole[self.places[self.start]], self.whole[self.places[self.start + self.size - 1]])
        return _join(both, self.size.astype(U))

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, window identifier) of each place whose window is the least of some string."""
        if not len(self.places):
            return self.start, self.mark
        known = np.zeros(len(self.windows) + self.spare, U)
        known[self.places + self.spare] = self.least
        at = np.flatnonzero(sliding(np.maximum, known, self.spare + 1)[: len(self.windows)] == self.windows)
        return np.searchsorted(self.first, at, side="right") - 1, self.windows[at]


def refined(texts: list[bytes], levels: list[tuple[int, int]]) -> list[Refined]:
    """Refined texts for each (length, window); the refinements up to the shorter ones serve the longer ones too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = identifiers(b"".join(texts), *(x for level in levels for x in level))
    return [Refined(sizes, length, window, ids[2 * i + 1], ids[2 * i]) for i, (length, window) in enumerate(levels)]


def _chunks(texts: list[bytes], limit: int = 1_000_000):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids >> U(24)) % U(n)


def _sorted_texts(table: pa.Table) -> tuple[list, list[bytes]]:
    """Keys and texts of a block in an order that doesn't depend on how the rows arrived."""
    rows = table.sort_by([("h", "ascending"), ("k", "ascending")])
    return rows["k"], [t.encode() for t in rows["t"].to_pylist()]


RUNS, AGAIN = -1, -2  # in place of a bucket: rows that a block keeps for itself
SENT = "block string, bucket long, ids binary"
SENT_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("ids", pa.binary())])
BITS = "block string, bucket long, bits binary"
BITS_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("bits", pa.binary())])
MARKS = "block string, bucket long, ids binary, contexts binary, twice binary, mixed binary"
MARKS_ARROW = pa.schema([*SENT_ARROW, ("contexts", pa.binary()), ("twice", pa.binary()), ("mixed", pa.binary())])
KNOWN = "block string, bucket long, alike binary, mixed binary"
KNOWN_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("alike", pa.binary()), ("mixed", pa.binary())])


def _shares(ids: np.ndarray, n: int):
    """(bucket, places of its identifiers in the order they come in)."""
    bucket = _bucket(ids, n)
    order = np.argsort(bucket, kind="stable")
    for b, i, j in _edges(bucket[order]):
        yield b, order[i:j]


def _gather(ids, contexts, count, mixed):
    """Marks summed up: distinct identifiers, a context, count (2 at most) and whether contexts or places differ."""
    order = np.lexsort([contexts, ids])
    ids, contexts, count, mixed = ids[order], contexts[order], count[order], mixed[order]
    if not len(ids):
        return ids, contexts, count, mixed
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    differ = np.logical_or.reduceat(mixed, first) | (contexts[first] != contexts[last])
    return ids[first], contexts[first], np.minimum(np.add.reduceat(count, first), 2), differ


def _known(marks: DataFrame) -> DataFrame:
    """For each packet its marks that occur twice or more: those whose strings cover the same bytes wherever they occur
    (alike: all of them are repeated), and those that must be refined further (mixed)."""

    def count(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x.as_buffer(), U) for x in table["ids"]]
        sizes = [len(i) for i in ids]
        flags = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table[name], sizes)])
        contexts = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table["contexts"]])
        contexts = contexts if len(contexts) else np.zeros(sum(sizes), U)  # marks without contexts
        all_ids, _, counts, mixed = _gather(np.concatenate(ids), contexts, flags("twice").astype(np.int64) + 1, flags("mixed").astype(bool))
        lists = [all_ids[(counts > 1) & ~mixed], all_ids[(counts > 1) & mixed]]
        rows = []
        for block, bucket, own in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), ids):
            alike, other = (own[_among(own, x)].tobytes() for x in lists)
            rows.append({"block": block, "bucket": bucket, "alike": alike, "mixed": other})
        return pa.Table.from_pylist(rows, KNOWN_ARROW)

    return marks.groupBy("bucket").applyInArrow(count, KNOWN)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _answers(packets: DataFrame) -> DataFrame:
    """For each packet a bit for each identifier: whether it occurs twice or more over all packets of its bucket."""

    def count(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x.as_buffer(), U) for x in table["ids"]]
        known, counts = np.unique(np.concatenate(ids), return_counts=True)
        again = known[counts > 1]
        bits = [np.packbits(_among(own, again)).tobytes() for own in ids]
        return pa.Table.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(bits, pa.binary())], schema=BITS_ARROW)

    return packets.groupBy("bucket").applyInArrow(count, BITS)


def _spread(table: pa.Table, ids_bucket: np.ndarray) -> np.ndarray:
    """Bits of a block's packets, back in the order in which the identifiers were sent."""
    out = np.zeros(len(ids_bucket), bool)
    order = np.argsort(ids_bucket, kind="stable")
    edge = {int(b): (i, j) for b, i, j in _edges(ids_bucket[order])}
    for b, bits in zip(table["bucket"].to_pylist(), table["bits"]):
        i, j = edge[b]
        out[order[i:j]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=j - i).astype(bool)
    return out


def _edges(values: np.ndarray):
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        yield from zip(values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)])


def remove_repeats(
    docs: DataFrame, length: int = 400, block_bytes: int = 4 << 20, buckets: int | None = None,
    key: str = "doc_id", text: str = "text", keep_bytes: bool = False, report: int | None = None,
) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if asked for;
    and n_repeated, the bytes under strings of the shorter length `report` whose least window, of 99 bytes less, occurs
    at another place too: all bytes that repeat at that length, and some around shorter repeats. Passages of some
    50 words often have fewer than 400 bytes).

    A byte goes if a string of `length` bytes (64 or more) over it also starts at another place of any text, its own
    included; strings never cross texts. Null text: as the empty one. Rows equal in all are repeats of each other. A
    text shorter than the length loses nothing. Null keys are kept. An empty table gives an empty table; other columns are
    left out. Texts are held a block at a time, a longer one alone.
    """
    levels = [(x, x - min(x // 2, 99)) for x in (length, report) if x]  # exact for the first, marks alone for the second
    docs = scanned(docs.select(key, text), "repeat-texts")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(block_of(key, text, block_bytes).alias("block"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), body.alias("t"))
    n = buckets or max(64, 2 * docs.rdd.getNumPartitions())

    def send(batches):
        found = defaultdict(list)
        for batch in batches:
            blocks = batch.column(0).to_pylist()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                names = np.array(blocks[a:b])
                for level, r in enumerate(refined(texts[a:b], levels)):
                    if not len(r.start):
                        continue
                    owner, ids = r.marked()
                    owner, runs_of = names[owner], names[r.owner[r.start]]
                    contexts = r.contexts() if not level else None
                    for name in np.unique(owner):
                        own, places = np.unique(ids[owner == name], return_counts=True)
                        if level:
                            none = np.zeros(len(own), np.int64)
                            found[str(name), level].append((own, none.view(U), np.minimum(places, 2), none > 0))
                            continue
                        here = runs_of == name
                        one, context, _, mixed = _gather(r.mark[here], contexts[here], np.ones(here.sum(), np.int64), np.zeros(here.sum(), bool))
                        # two places of a mark in one run of strings: they may cover less than the run together
                        runs = np.unique(r.mark[here], return_counts=True)[1]
                        found[str(name), level].append((own, context, np.minimum(places, 2), mixed | (runs != places)))
        for name, level in list(found):
            ids, contexts, counts, mixed = _gather(*map(np.concatenate, zip(*found.pop((name, level)))))
            rows = [
                {"block": name, "bucket": b + level * n, "ids": ids[at].tobytes(), "contexts": b"" if level else contexts[at].tobytes(),
                 "twice": np.packbits(counts[at] > 1).tobytes(), "mixed": np.packbits(mixed[at]).tobytes()}
                for b, at in _shares(ids, n)
            ]
            yield pa.RecordBatch.from_pylist(rows, MARKS_ARROW)

    marks = stash(_known(base.select("block", "t").mapInArrow(send, MARKS)), "repeat-marks")
    state = "block string, bucket long, ids binary, kind string, runs binary"
    state_arrow = pa.schema([*SENT_ARROW, ("kind", pa.string()), ("runs", pa.binary())])
    small = np.uint8 if n <= 256 else np.uint32

    def refine(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        name, (_, texts) = group[0].as_py(), _sorted_texts(left)
        level_of = right["bucket"].to_numpy() // n
        lists = {(c, k): [np.zeros(0, U)] for c in ("alike", "mixed") for k in range(len(levels))}
        for c, k in lists:
            lists[c, k] += [np.frombuffer(x.as_buffer(), U) for x, own in zip(right[c], level_of) if own == k]
        known = {k: np.sort(np.concatenate(v)) for k, v in lists.items()}
        last, reached = None, 0
        runs, wholes, again = [np.zeros((0, 4), np.int64)], [np.zeros(0, U)], np.zeros(len(texts), np.int64)
        for a, b in _chunks(texts):
            for k, r in enumerate(refined(texts[a:b], levels)):
                if not len(r.start):
                    continue
                more, alike = _among(r.mark, known["mixed", k]), _among(r.mark, known["alike", k])
                some = np.flatnonzero(more | alike)
                s = r.start[some]
                if k:
                    for doc, offset, size in zip(r.owner[s].tolist(), r.offset[s].tolist(), r.size[some].tolist()):
                        edge = max(offset, reached) if (doc, a) == last else offset
                        again[doc + a] += max(offset + size - 1 + report - edge, 0)
                        last, reached = (doc, a), max(offset + size - 1 + report, edge)
                    continue
                runs.append(np.column_stack([r.owner[s] + a, r.offset[s], r.size[some], more[some]]).astype(np.int64))
                wholes.append(r.whole[r.places[np.repeat(more, r.size)]])
        whole, own = np.concatenate(wholes), np.concatenate(runs)
        rows = [{"block": name, "bucket": b, "ids": whole[at].tobytes(), "kind": "ids", "runs": None} for b, at in _shares(whole, n)]
        rows.append({"block": name, "bucket": RUNS, "ids": _bucket(whole, n).astype(small).tobytes(), "kind": "runs", "runs": own.tobytes()})
        rows.append({"block": name, "bucket": AGAIN, "ids": b"", "kind": "runs", "runs": again.tobytes()})
        return pa.Table.from_pylist(rows, state_arrow)

    sent = stash(base.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(refine, state), "repeat-strings")
    answers = _answers(sent.where("kind = 'ids'").select("block", "bucket", "ids"))
    back = answers.select("block", "bucket", "bits", F.lit(None).cast("binary").alias("runs"), F.lit(None).cast("binary").alias("ids"))
    back = back.unionByName(sent.where("kind = 'runs'").select("block", "bucket", F.lit(None).cast("binary").alias("bits"), "runs", "ids"))
    kind = docs.schema[key].dataType.simpleString()
    result = f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(report) + ", kept binary" * keep_bytes

    def repeated(table: pa.Table) -> dict[int, list[np.ndarray]]:
        """For each text of a block the places that start a repeated string."""
        numbers = table["bucket"].to_numpy()
        starts: dict[int, list] = defaultdict(list)
        for i in np.flatnonzero(numbers == RUNS).tolist():
            runs = np.frombuffer(table["runs"][i].as_buffer(), np.int64).reshape(-1, 4)
            bucket = np.frombuffer(table["ids"][i].as_buffer(), small)
            bits = _spread(table.filter(pa.array(numbers >= 0)), bucket)
            at = 0
            for doc, offset, size, asked in runs.tolist():
                hit = np.flatnonzero(bits[at : at + size]) if asked else np.arange(size)
                at += size * asked
                if len(hit):
                    starts[doc].append(hit + offset)
        return starts

    def under(starts: list[np.ndarray], size: int) -> np.ndarray:
        edge = np.zeros(size + 1, np.int32)
        s = np.concatenate(starts)
        edge[s] += 1
        edge[s + length] -= 1
        return np.cumsum(edge[:-1]) > 0

    def cut(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = _sorted_texts(left)
        starts = repeated(right)
        again = [np.frombuffer(x.as_buffer(), np.int64) for x, b in zip(right["runs"], right["bucket"].to_pylist()) if b == AGAIN]
        sizes = [len(t) for t in texts]
        removed, spans, digests, left_bytes = [], [], [], []
        for i, t in enumerate(texts):
            if i in starts:
                gone = under(starts[i], len(t))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                t = np.frombuffer(t, np.uint8)[~gone].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            digests.append(hashlib.sha256(t).hexdigest())
            if keep_bytes:
                left_bytes.append(t)
        out = {
            "k": keys, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        if report:
            out["n_repeated"] = pa.array(np.concatenate([*again, np.zeros(0, np.int64)]), pa.int64())
        if keep_bytes:
            out["kept"] = pa.array(left_bytes, pa.binary())
        return pa.table(out)

    return base.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, result).withColumnRenamed("k", key)
