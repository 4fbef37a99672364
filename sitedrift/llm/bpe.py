"""Byte-pair encoding and decoding by a pair occurrence index.

Pieces not met before in a worker are laid end to end as one symbol array. The index maps each mergeable pair to all
its positions; ranks become active as their pairs appear and are applied in ascending order, each to all its positions
from left to right, and every merge puts the two pairs it makes with its neighbours into the lists of their ranks.
A text is then the concatenation of its pieces' ids.

Defined results: null text is the empty text (no ids, empty decoding); special strings inside texts become their
special token, as the vocabulary's library does by default; bytes that are not UTF-8 decode to U+FFFD; repeated rows
are encoded alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import _JOIN, Vocabulary, parsed, ship

#: Distinct pieces whose ids a worker keeps; beyond that it starts afresh.
CACHE_PIECES = 600_000
#: Rows handled together; bounds the memory of a batch.
BATCH_ROWS = 256

_CACHE: dict[int, dict[str, tuple[int, ...]]] = {}


def encode_pieces(pieces: list[str], v: Vocabulary) -> list[tuple[int, ...]]:
    """Ids of each piece (pieces aren't empty)."""
    sym: list[int] = []
    piece_of: list[int] = []
    for k, piece in enumerate(pieces):
        s = v.symbols(piece)
        sym += s
        piece_of += [k] * len(s)
    n = len(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    for i in range(1, n):
        if piece_of[i] != piece_of[i - 1]:
            left[i], right[i - 1] = -1, n
    if n:
        right[n - 1] = n

    merges, index, active = v.merges, {}, []
    merged: dict[int, tuple[int, int, int]] = {}

    def note(i: int, j: int) -> None:
        pair = sym[i] * _JOIN + sym[j]
        if (found := merges.get(pair)) is not None:
            rank = found[0]
            if (at := index.get(rank)) is None:
                index[rank] = [i]
                merged[rank] = (sym[i], sym[j], found[1])
                heappush(active, rank)
            else:
                at.append(i)

    for i in range(n - 1):
        if right[i] < n:
            note(i, i + 1)
    while active:
        rank = heappop(active)
        a, b, new = merged[rank]
        at = index.pop(rank)
        at.sort()
        for i in at:
            if sym[i] != a or (j := right[i]) >= n or sym[j] != b:
                continue  # an earlier merge has used one of the two
            sym[i], sym[j] = new, -1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                note(i, after)
            if (before := left[i]) >= 0:
                note(before, i)
    out: list[list[int]] = [[] for _ in pieces]
    for k, s in zip(piece_of, sym, strict=True):
        if s >= 0:
            out[k].append(s)
    return [tuple(x) for x in out]


def encode_texts(texts: Iterable[str | None], v: Vocabulary) -> Iterator[list[int]]:
    """Ids of each text; all pieces of these texts that the worker lacks are merged together."""
    cache = _CACHE.setdefault(id(v), {})
    if len(cache) > CACHE_PIECES:
        cache.clear()
    split = [list(v.segments(t)) if t else [] for t in texts]
    fresh = dict.fromkeys(p for segments in split for _, pieces in segments for p in pieces if p not in cache)
    if fresh:
        cache.update(zip(fresh, encode_pieces(list(fresh), v), strict=True))
    for segments in split:
        ids: list[int] = []
        for special, pieces in segments:
            if special >= 0:
                ids.append(special)
            else:
                ids += chain.from_iterable(map(cache.__getitem__, pieces))
        yield ids


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    return b"".join(map(v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def bpe_encode(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each whole text."""
    shipped = ship(docs.sparkSession, vocab_path)

    def run(batches):
        v = parsed(shipped.value)
        for b in _by_rows(batches):
            ids = list(encode_texts(b.column(1).to_pylist(), v))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def bpe_decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids are the empty text."""
    shipped = ship(encoded.sparkSession, vocab_path)

    def run(batches):
        v = parsed(shipped.value)
        for b in _by_rows(batches):
            texts = [decode_ids(x or (), v) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, so ids never leave the task."""
    shipped = ship(docs.sparkSession, vocab_path)

    def run(batches):
        v = parsed(shipped.value)
        names = list(map(str, range(len(v.token_bytes))))
        for b in _by_rows(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in encode_texts(b.column(1).to_pylist(), v):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(ids, v).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
