"""Token counts by byte-pair merging over a linked list of symbols with a heap of the pairs that may merge.

The heap gives the adjacent pair of lowest rank, leftmost first; a merge unlinks the right symbol and offers the two
new neighbouring pairs. A stale offer (its symbols have changed since) is skipped. The count is the initial number of
bytes less the merges done; no identifiers come out.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PAIR, Cutter, Vocabulary


def count_after_merges(symbols: list[int], rank: dict[int, int], merges: list[tuple[int, int, int]]) -> int:
    """Number of symbols left when no adjacent pair of the list can be merged any more. Uses up symbols."""
    n = len(symbols)
    # an offer is rank << 32 | place of the left symbol, so that the heap compares plain numbers
    heap = []
    for i in range(n - 1):
        found = rank.get(symbols[i] << PAIR | symbols[i + 1])
        if found is not None:
            heap.append(found << 32 | i)
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    left = n
    while heap:
        offer = heappop(heap)
        i = offer & 0xFFFFFFFF
        j = after[i]
        # stale: one of the two symbols has gone into another since
        if j >= n or symbols[i] < 0 or rank.get(symbols[i] << PAIR | symbols[j]) != offer >> 32:
            continue
        made = symbols[i] = merges[offer >> 32][2]
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = rank.get(made << PAIR | symbols[k])
            if found is not None:
                heappush(heap, found << 32 | i)
        h = before[i]
        if h >= 0:
            found = rank.get(symbols[h] << PAIR | made)
            if found is not None:
                heappush(heap, found << 32 | h)
    return left


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str):
    v = Vocabulary(path, pattern)
    ids = v.byte_id

    def of_piece(piece: str) -> int:
        return count_after_merges([ids[b] for b in piece.encode("utf-8", "replace")], v.rank, v.merges)

    cutter = Cutter(v, of_piece, sum)

    def count(text: str) -> int:
        for mark in v.special:
            if mark in text:
                return sum(1 if part in v.special else cutter.of_text(part) for part in v.special_cut(text))
        return cutter.of_text(text)

    return count


def token_count_column(text, vocabulary: str, pattern: str):
    """Column of token counts; null counts as the empty text. Row-local and Arrow-batched: it never shuffles."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = _counter(vocabulary, pattern)
        return pa.array([count(t.as_py() or "") for t in texts], pa.int64())

    return counted(text)


def count_tokens(
    docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit.

    Null or empty text: 0 bytes, 0 tokens. Null keys, repeated rows and further columns are kept as rows / ignored as
    columns; an empty table gives an empty table. Texts of any length are counted whole.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(key), F.octet_length(body).cast("long").alias("n_bytes"),
        token_count_column(body, vocabulary, pattern).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
