"""Packing documents into token windows by lexical retrieval.

Each task cuts its rows into shards of a bounded number of tokens and indexes a shard's open documents by BM25 (term:
documents and weights). A seed document opens a window; the index returns its unused neighbours in falling score, and
they fill the window greedily. The one that doesn't fit whole is cut: its rest seeds the next window. Documents of a
window or more give whole windows first. So only the last window of a shard is part-filled. These remainders, one
for each shard, are then put together, the longest first, each into the first window with room for it, so padding doesn't
grow with the number of tasks. Nothing else is shuffled, a shard's memory is bounded, and the same input split always
packs alike.

Defined results: null text is the empty text, one end token; empty texts are packed like others; repeated rows are
separate documents; no rows give no pieces; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .vocab import parsed, ship
from .word_ids import WordIds

WINDOW = 2048
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
BATCH_ROWS = 512

#: Remainders that are put together by one task.
GROUP = 512

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
FILLED = f"{SCHEMA}, filled long"
Piece = tuple[int, int, int]  # document, start, length


class Bm25:
    """Postings of a shard by term; ask() scores documents against one of them, by all of its terms."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        pair, tf = np.unique((owner << 17) | np.concatenate(docs), return_counts=True)
        doc, term = pair >> 17, pair & ((1 << 17) - 1)
        terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.n, self.term = n, term.astype(np.int32)
        self.own = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self._postings(doc[order].astype(np.int32), self.term[order], weight[order], len(df))

    def _postings(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        self.doc, self.of, self.weight = doc, term, weight
        self.df = np.bincount(term, minlength=n_terms)
        self.begin = np.cumsum(self.df) - self.df

    def keep(self, is_open: np.ndarray) -> None:
        """Forgets the postings of closed documents; weights stay those of the whole shard."""
        left = is_open[self.doc]
        self._postings(self.doc[left], self.of[left], self.weight[left], len(self.df))

    def ask(self, seed: int) -> np.ndarray:
        """Documents that share a term with the seed, best first, ties in order of rows."""
        terms = self.term[self.own[seed] : self.own[seed + 1]]
        size = self.df[terms]
        first = np.cumsum(size) - size
        at = np.repeat(self.begin[terms] - first, size) + np.arange(int(size.sum()))
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Sequences of pieces that cover each document once; all but the last are full."""
    start = []
    for d, ids in enumerate(docs):
        whole = len(ids) // window * window
        for s in range(0, whole, window):
            yield [(d, s, window)]
        start.append(whole)
    is_open = np.array([s < len(ids) for s, ids in zip(start, docs, strict=True)], bool)
    if not is_open.any():
        return
    index = Bm25([ids[s:] for s, ids in zip(start, docs, strict=True)])
    held = int(is_open.sum())
    queue = iter(range(len(docs)))
    seed, sequence, room = None, [], window

    def put(d: int) -> bool:
        """Adds what fits of a document; true if it was cut."""
        nonlocal room
        n = min(room, len(docs[d]) - start[d])
        sequence.append((d, start[d], n))
        start[d] += n
        room -= n
        is_open[d] = start[d] < len(docs[d])
        return bool(is_open[d])

    while True:
        if seed is None:
            seed = next((d for d in queue if is_open[d]), None)
            if seed is None:
                break
        first, rest = seed, None
        cut = put(first)
        while room and not cut:
            near = index.ask(first)
            for d in near[is_open[near]]:
                cut = put(int(d))
                if not room:
                    rest = int(d) if cut else None
                    break
            if room:
                first = next((d for d in queue if is_open[d]), None)
                if first is None:
                    break
                cut = put(first)
                rest = first if cut else None
        if room:
            break
        yield sequence
        if (left := int(is_open.sum())) < 0.8 * held:
            index.keep(is_open)
            held = left
        seed, sequence, room = (rest if rest is not None else first if cut else None), [], window
    if sequence:
        yield sequence


def pack_documents(
    docs: DataFrame,
    vocab_path: str,
    end_id: int = 1,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece, SCHEMA; end_id closes each document."""
    shipped = ship(docs.sparkSession, vocab_path)

    def run(batches):
        coder = WordIds.of(parsed(shipped.value))
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        base = TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal base
            out = []
            for sequence in pack(ids, window):
                offset, filled = 0, sum(n for _, _, n in sequence)
                for d, s, n in sequence:
                    crc = zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes())
                    out.append((keys[d], s, n, crc, len(ids[d]), base, offset, filled))
                    offset += n
                base += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            names = [x.split()[0] for x in FILLED.split(", ")]
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                keys += part.column(0).to_pylist()
                fresh = [np.append(x, np.int32(end_id)) for x in coder.texts(part.column(1).to_pylist())]
                ids += fresh
                held += sum(map(len, fresh))
                if held >= shard_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, FILLED)
    pieces = stored(rows, "pieces")
    whole = pieces.where(F.col("filled") == window).drop("filled")
    rest = pieces.where(F.col("filled") < window)
    groups = max(1, -(-rest.where("offset = 0").count() // GROUP))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        at = put_together(pdf.drop_duplicates("sequence_id").set_index("sequence_id")["filled"].to_dict(), window)
        pdf["offset"] += pdf["sequence_id"].map(lambda i: at[i][1])
        pdf["sequence_id"] = pdf["sequence_id"].map(lambda i: at[i][0])
        return pdf.drop(columns=["filled", "group"])

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInPandas(together, SCHEMA))


def put_together(filled: dict[int, int], window: int) -> dict[int, tuple[int, int]]:
    """(sequence, offset) for each part-filled sequence: the longest first, into the first with room for it."""
    out, room = {}, {}
    for i, n in sorted(filled.items(), key=lambda x: (-x[1], x[0])):
        home = next((k for k, free in room.items() if free >= n), i)
        free = room.get(home, window)
        out[i] = (home, window - free)
        room[home] = free - n
    return out
