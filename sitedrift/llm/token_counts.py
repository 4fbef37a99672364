"""Token counts by heap-and-linked-list byte-pair merging.

Each distinct piece of a worker's texts is a linked list of symbols. A heap holds its mergeable adjacent pairs as
(rank, position); the lowest rank is popped again and again, stale entries are skipped, and a merge links its neighbours
anew. The count is the initial symbols less the merges; no ids are made.

Defined results: null text counts as empty (0 tokens, 0 bytes); a special string inside a text is one token, as in the
vocabulary's library; repeated rows count alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import _JOIN, Vocabulary, parsed, ship

#: Distinct pieces whose counts a worker keeps; beyond that it starts afresh.
CACHE_PIECES = 1_000_000

_CACHE: dict[int, dict[str, int]] = {}


def count_piece(piece: str, v: Vocabulary) -> int:
    sym = v.symbols(piece)
    n = count = len(sym)
    if n == 1:
        return 1
    merges = v.merges
    heap = []
    for i in range(n - 1):
        if (m := merges.get(sym[i] * _JOIN + sym[i + 1])) is not None:
            heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
    heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        _, i, new, a, b = heappop(heap)
        j = right[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # stale: one of the two has merged meanwhile
        sym[i], sym[j] = new, -1
        count -= 1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            if (m := merges.get(new * _JOIN + sym[after])) is not None:
                heappush(heap, (m[0], i, m[1], new, sym[after]))
        before = left[i]
        if before >= 0 and (m := merges.get(sym[before] * _JOIN + new)) is not None:
            heappush(heap, (m[0], before, m[1], sym[before], new))
    return count


class _Counts(dict):
    """piece: tokens, counted when first asked for."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def __missing__(self, piece: str) -> int:
        self[piece] = n = count_piece(piece, self.v)
        return n


def count_text(text: str | None, v: Vocabulary) -> int:
    cache = _CACHE.get(id(v))
    if cache is None or len(cache) > CACHE_PIECES:
        cache = _CACHE[id(v)] = _Counts(v)
    total = 0
    for special, pieces in v.segments(text or ""):
        total += 1 if special >= 0 else sum(map(cache.__getitem__, pieces))
    return total


def token_counts(
    docs: DataFrame, vocab_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    shipped = ship(docs.sparkSession, vocab_path)

    def run(batches):
        v = parsed(shipped.value)
        for b in batches:
            counts = [count_text(t.as_py(), v) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
