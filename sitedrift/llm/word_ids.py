"""Ids of many distinct pieces at once in numpy, and of texts by looking their pieces up.

Pieces of equal length form a matrix; in each round every row merges its leftmost pair of lowest rank, so all rows stay
equally long, and rows without a pair are done. A round copies the matrix, so pieces of more than ``LONG`` bytes are
merged one by one instead, with a heap of pairs over a linked list.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

from .vocab import _JOIN, Vocabulary

#: Bytes of a piece in a matrix.
LONG = 128
#: Distinct pieces that a worker keeps; beyond that it starts afresh.
CACHE_PIECES = 800_000

_CACHE: dict[int, WordIds] = {}
_NONE = np.int32(2**31 - 1)


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def merge_long(sym: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of one piece of any length from its symbols: lowest rank first, of equal ones the leftmost; n log n steps."""
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> tuple[int, int, int, int, int] | None:
        j = after[i]
        found = merges.get(sym[i] * _JOIN + sym[j]) if j < n else None
        return None if found is None else (found[0], i, sym[i], sym[j], found[1])

    heap = [x for x in map(offer, range(n)) if x is not None]
    heapify(heap)
    while heap:
        _, i, a, b, merged = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two has merged since
        sym[i], sym[j] = merged, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for at in (before[i], i):
            if at >= 0 and (x := offer(at)) is not None:
                heappush(heap, x)
    return [s for s in sym if s >= 0]


class PairTable:
    """rank and merged id of pairs by a hash of 2^19 slots; the few pairs that share a slot are searched for."""

    BITS, FACTOR = 19, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, merges: dict[int, tuple[int, int]]):
        keys = np.fromiter(merges, np.int64, len(merges))
        found = np.array(list(merges.values()), np.int32).reshape(-1, 2)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.key = np.full(1 << self.BITS, -1, np.int64)
        self.val = np.full((1 << self.BITS, 2), _NONE, np.int32)
        self.key[slot[first]], self.val[slot[first]] = keys[first], found[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_val = keys[rest], found[rest]
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[slot[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.BITS)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, merged ids); rank _NONE where the pair doesn't merge."""
        keys = a.astype(np.int64) * _JOIN + b
        slot = self._slot(keys)
        hit = self.key[slot] == keys
        out = np.where(hit[..., None], self.val[slot], _NONE)
        if len(self.rest_key) and (ask := ~hit & self.shared[slot]).any():
            k = keys[ask]
            at = np.minimum(np.searchsorted(self.rest_key, k), len(self.rest_key) - 1)
            out[ask] = np.where((self.rest_key[at] == k)[:, None], self.rest_val[at], _NONE)
        return out[..., 0], out[..., 1]


class _Numbers(dict):
    """Numbers pieces as they are asked for; fresh: those not encoded yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class WordIds:
    def __init__(self, v: Vocabulary):
        self.v, self.table = v, PairTable(v.merges)
        self.first, self.last = np.array(v.first, np.int32), np.array(v.last, np.int32)
        self.clear()

    def clear(self) -> None:
        self.at = _Numbers()
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    @staticmethod
    def of(v: Vocabulary) -> WordIds:
        if id(v) not in _CACHE:
            _CACHE[id(v)] = WordIds(v)
        return _CACHE[id(v)]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of non-empty pieces."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        length = np.zeros(len(raw), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > LONG):
            ids = np.array([merge_long(self.v.symbols(pieces[i]), self.v.merges)], np.int32)
            length[i] = ids.shape[1]
            done.append((np.array([i]), ids))
        for size in np.unique(sizes[sizes <= LONG]):
            rows = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size)
            sym = self.first[data]
            sym[:, -1] = self.last[data[:, -1]]
            if size > 1:
                rank, new = self.table.look_up(sym[:, :-1], sym[:, 1:])
            while True:
                width = sym.shape[1]
                if width > 1:
                    col = rank.argmin(1)
                    going = rank[np.arange(len(rows)), col] != _NONE
                else:
                    going = np.zeros(len(rows), bool)
                if not going.all():
                    length[rows[~going]] = width
                    done.append((rows[~going], sym[~going]))
                if not going.any():
                    break
                rows, sym, rank, new, col = rows[going], sym[going], rank[going], new[going], col[going]
                n = np.arange(len(rows))
                sym[n, col] = new[n, col]
                keep = np.ones(sym.shape, bool)
                keep[n, col + 1] = False
                sym = sym[keep].reshape(len(rows), width - 1)
                drop = np.ones(rank.shape, bool)
                drop[n, col] = False
                rank, new = rank[drop].reshape(len(rows), width - 2), new[drop].reshape(len(rows), width - 2)
                for side in (col - 1, col):
                    ok = np.flatnonzero((side >= 0) & (side < width - 2))
                    at = side[ok]
                    rank[ok, at], new[ok, at] = self.table.look_up(sym[ok, at], sym[ok, at + 1])
        start = np.cumsum(length, dtype=np.int64) - length
        flat = np.zeros(int(length.sum()), np.int32)
        for rows, sym in done:
            if len(rows):
                flat[start[rows][:, None] + np.arange(sym.shape[1])] = sym
        return length, flat

    def known(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for pieces that may have been met before."""
        if len(self.at) > CACHE_PIECES:
            self.clear()
        k = list(map(self.at.__getitem__, pieces))
        self._encode_fresh()
        return self.length[np.array(k, np.int64)], self.gather(k)

    def _encode_fresh(self) -> None:
        if not self.at.fresh:
            return
        length, flat = self.encode(self.at.fresh)
        self.at.fresh = []
        start = np.cumsum(length, dtype=np.int64) - length + len(self.flat)
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat])

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, null as empty; special strings become their tokens."""
        if len(self.at) > CACHE_PIECES:
            self.clear()
        number = self.at.__getitem__
        split = [[(special, list(map(number, pieces))) for special, pieces in self.v.segments(t)] if t else [] for t in texts]
        self._encode_fresh()
        out = []
        for segments in split:
            parts = [np.array([special], np.int32) if special >= 0 else self.gather(k) for special, k in segments]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return out

    def gather(self, known: list[int]) -> np.ndarray:
        k = np.array(known, np.int64)
        n = self.length[k]
        begin = np.cumsum(n, dtype=np.int64) - n
        return self.flat[np.repeat(self.start[k] - begin, n) + np.arange(int(n.sum()))]
