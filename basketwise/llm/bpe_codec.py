"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its encoding. Prefixes are taken left to right; a suffix
automaton over the vocabulary (states are the token strings' prefixes, failure links lead to the next shorter suffix)
lists the tokens that end at the current byte, longest first. A token fits if what stands before it is empty, or if the
pair (last token of that shorter prefix, token) is compatible: no merge would ever have crossed their border. The one
that fits is stored for the prefix; following the stored tokens back from the end gives the exact ids.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PAIR, Bounded, Cutter, Vocabulary


class PrefixEncoder:
    """Encodes one piece at a time; tables are built once per worker from the vocabulary."""

    def __init__(self, v: Vocabulary):
        self.rank = v.rank
        self.parts = {made: (rank, a, b) for rank, (a, b, made) in reversed([*enumerate(v.merges)])}
        tokens = {v.bytes_of[i]: i for i in [*v.byte_id, *self.parts]}
        self.fits = Bounded(lambda pair: self.compatible(pair >> PAIR, pair & (1 << PAIR) - 1), 300_000)
        self._automaton(tokens)

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        go: list[dict[int, int]] = [{}]
        ends = [-1]
        depth = [0]
        for word, i in tokens.items():
            s = 0
            for b in word:
                t = go[s].get(b)
                if t is None:
                    t = go[s][b] = len(go)
                    go.append({})
                    ends.append(-1)
                    depth.append(depth[s] + 1)
                s = t
            ends[s] = i
        link = [0] * len(go)
        layer = list(go[0].values())
        matches: list[tuple] = [()] * len(go)
        for s in layer:
            matches[s] = ((ends[s], 1),) if ends[s] >= 0 else ()
        while layer:
            later = []
            for s in layer:
                for b, t in go[s].items():
                    f = link[s]
                    while b not in go[f] and f:
                        f = link[f]
                    link[t] = go[f].get(b, 0)
                    own = ((ends[t], depth[t]),) if ends[t] >= 0 else ()
                    matches[t] = own + matches[link[t]]
                    later.append(t)
            layer = later
        self.go, self.link, self.matches = go, link, matches

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding bytes(left)+bytes(right) leaves the two as they are.

        Walks their derivations backwards in time. At each point the symbols at the border are known; had they a
        merge that came before the step that used up either of them, the border would have been crossed.
        """
        rank, parts = self.rank, self.parts
        bound = float("inf")  # merges of a lower rank than this would have come first
        while True:
            crossing = rank.get(left << PAIR | right)
            if crossing is not None and crossing < bound:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                bound, left = a[0], a[2]
            else:
                # at equal rank the crossing pair stands further left and so comes first
                bound, right = b[0] + 0.5, b[1]

    def ids(self, data: bytes) -> list[int]:
        go, link, matches, fits = self.go, self.link, self.matches, self.fits
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        s = 0
        for end, b in enumerate(data, 1):
            while b not in go[s] and s:
                s = link[s]
            s = go[s].get(b, 0)
            for token, n in matches[s]:
                start = end - n
                if not start or (last[start] >= 0 and fits[last[start] << PAIR | token]):
                    last[end], size[end] = token, n
                    break
        out = []
        end = len(data)
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(path, pattern)
        encoder = PrefixEncoder(self.v)

        def of_piece(piece: str) -> bytes:
            return np.array(encoder.ids(piece.encode("utf-8", "replace")), "<u4").tobytes()

        self.cutter = Cutter(self.v, of_piece, b"".join)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.v.special.items()}
        top = max(self.v.bytes_of) + 1
        self.table = [self.v.bytes_of.get(i, b"") for i in range(top)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        for mark in self.special:
            if mark in text:
                return b"".join(self.special.get(p) or self.cutter.of_text(p) for p in self.v.special_cut(text))
        return self.cutter.of_text(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_column(text, vocabulary: str, pattern: str):
    """Binary column of ids (little-endian unsigned 32-bit); null encodes as the empty text."""

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        encode = codec(vocabulary, pattern).encode
        return pa.array([encode(t.as_py() or "") for t in texts], pa.binary())

    return encoded(text)


def decode_column(ids, vocabulary: str, pattern: str):
    """Text column from a binary column of ids; null decodes to the empty text."""

    @F.arrow_udf("string")
    def decoded(blobs: pa.Array) -> pa.Array:
        decode = codec(vocabulary, pattern).decode
        return pa.array([decode(b.as_py() or b"") for b in blobs], pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text"):
    """key, ids (binary), n_tokens per input row, in whole texts and without a shuffle.

    Null or empty text: no ids. Repeated rows and null keys give a row each; further columns are left out.
    """
    ids = encode_column(F.col(text), vocabulary, pattern)
    return docs.select(F.col(key), ids.alias("ids")).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def digest_round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text"):
    """key, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        c = codec(vocabulary, pattern)
        n, a, b = [], [], []
        for t in texts:
            ids = c.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col(key), digest(F.col(text)).alias("d")).select(key, "d.*")
