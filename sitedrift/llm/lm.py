"""Language-model scores of documents: a word-count base and the attention model of attention.py.

1. One pass over the texts cuts each task's rows into chunks of bounded size and stores them compactly: the distinct
   words (hashes in order, subword ids, counts in training documents) and each document as numbers of those words.
2. Word counts: each chunk's words are dealt by ranges of their 64-bit hash. A range adds its chunks' counts up and
   gives each chunk the totals of its words back, as blocks of numbers: no row per word, and none at the driver.
   Subword counts, and pair counts by context, have a size fixed by the vocabulary and become the model's tables.
3. Training is data-parallel over shards of the training documents, dealt by the hash of their id and put in order of it,
   so shards don't depend on how the input is split. Their number follows from the number of training tokens. In each
   of ``ROUNDS`` rounds every shard goes through another ``ROUNDS``-th of its windows, so each window is gone
   through; the parameters are then averaged by windows. Where a shard has few windows, it goes through them
   several times (attention.train_windows).
4. Each chunk scores its documents.

Defined results: null text is the empty text, one end token; without training documents all counts are 0 and each base
term is log10(1); repeated rows score alike; rows without an id are scored like others; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .shared import stored
from .vocab import parsed, ship
from .word_ids import WordIds, lower_ascii

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text after which a chunk is closed; bounds a task's memory.
CHUNK_BYTES = 9_000_000
#: Words of a range of hashes, over all chunks, and training tokens of a shard, aimed at.
RANGE_WORDS, SHARD_TOKENS = 2_000_000, 4_000_000
ROUNDS, RATE = 3, 0.01
#: Steps of a shard in a round at least, where it has few windows.
MIN_STEPS = 150
#: Rows into which the tasks' parameters are summed before the driver adds them up.
SUMS = 16


def _pack(x: np.ndarray, dtype: str) -> bytes:
    """Compressed by planes of bytes: the high ones of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, dtype).view("u1").reshape(len(x), np.dtype(dtype).itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), "u1").reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_ids(ids: list[int | None]) -> tuple[bytes, bytes]:
    """Ids, 0 for those missing, and which are missing."""
    return _pack(np.array([i or 0 for i in ids], np.int64), "<i8"), _pack(np.array([i is None for i in ids]), "u1")


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    """Columns of long, boolean and binary values, and arrays of longs."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


class _Streams:
    """Subword ids of a chunk's documents, each closed by the end token."""

    def __init__(self, row, end: int):
        self.sizes, self.codes = _unpack(row.sizes, "<i4").astype(np.int64), _unpack(row.codes, "<i4")
        n, flat = _unpack(row.word_sizes, "<i4").astype(np.int64), _unpack(row.word_ids, "<i4")
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        start = np.cumsum(n) - n
        k = n[self.codes]
        begin = np.cumsum(k) - k
        ids = flat[np.repeat(start[self.codes] - begin, k) + np.arange(int(k.sum()))]
        words = np.bincount(self.doc, k, len(self.sizes)).astype(np.int64)
        self.lengths = words + 1
        self.ids = np.insert(ids, np.cumsum(words), end) if len(words) else ids


CHUNK = (
    "chunk long, doc_ids binary, no_id binary, learnt binary, sizes binary, codes binary, word_sizes binary, word_ids binary,"
    " hashes binary, counts binary, n_words long, n_ends long, n_learnt long, subwords array<long>, pairs binary, pair_counts binary"
)


def _chunk(number: int, ids: list, learnt: np.ndarray, texts: pa.Array, coder: WordIds) -> pa.RecordBatch:
    """A row of CHUNK from documents' ids, whether they are learnt from, and texts in lower case."""
    end = coder.v.specials["<|endoftext|>"]
    split = pc.split_pattern_regex(texts, SPACE)
    parts, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    there = pc.greater(pc.binary_length(parts), 0)
    sizes = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(ids))
    coded = pc.filter(parts, there).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    n, flat = coder.known([f" {words[i]}" for i in order.tolist()])
    row = pd.Series(
        {
            "sizes": _pack(sizes, "<i4"), "codes": _pack(place[codes], "<i4"),
            "word_sizes": _pack(n, "<i4"), "word_ids": _pack(flat, "<i4"),
        }
    )
    s = _Streams(row, end)
    counts = np.bincount(s.codes[learnt[s.doc]], minlength=len(words))
    mine = s.ids[np.repeat(learnt, s.lengths)]
    before = np.concatenate([[end], mine[:-1]])[: len(mine)]
    pairs, pair_counts = np.unique(before.astype(np.int64) << 20 | mine, return_counts=True)
    values = [
        number, *_pack_ids(ids), _pack(learnt, "u1"), row["sizes"], row["codes"], row["word_sizes"], row["word_ids"],
        _pack(np.diff(hashes[order], prepend=np.uint64(0)), "<u8"), _pack(counts, "<i4"), len(words), int(learnt.sum()),
        len(mine), np.bincount(mine, minlength=len(coder.v.token_bytes)), _pack(np.diff(pairs, prepend=0), "<i8"),
        _pack(pair_counts, "<i4"),
    ]
    return _batch(CHUNK, [[v] for v in values])


def _chunks(docs: DataFrame, learnt: Column, vocab_path: str, doc_id: str, text: str) -> DataFrame:
    shipped = ship(docs.sparkSession, vocab_path)

    def run(batches):
        coder, number = WordIds.of(parsed(shipped.value)), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        train: list[bool] = []
        texts: list[str] = []
        held = 0
        for b in batches:
            for i, t, is_train in zip(*(b.column(c) for c in range(3)), strict=True):
                body = lower_ascii(t.as_py() or "")
                ids.append(i.as_py())
                train.append(bool(is_train.as_py()))
                texts.append(body)
                held += len(body) + 100
                if held >= CHUNK_BYTES:
                    yield _chunk(number, ids, np.array(train, bool), pa.array(texts, pa.large_string()), coder)
                    number, held = number + 1, 0
                    ids, train, texts = [], [], []
        if ids:
            yield _chunk(number, ids, np.array(train, bool), pa.array(texts, pa.large_string()), coder)
        # the worker lives on, and training needs the memory
        coder.clear()

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text), F.coalesce(learnt, F.lit(False)).alias("_learnt")
    )
    return rows.mapInArrow(run, CHUNK)


def _word_totals(chunks: DataFrame, n_words: int) -> DataFrame:
    """of, part, counts (of the words of chunk ``of`` in hash range ``part``, in all training documents), and in one row of
    each range how many words it has that were counted, and their count."""
    ranges = max(1, -(-n_words // RANGE_WORDS))
    width = np.uint64(2**64 // ranges + 1) if ranges > 1 else None
    dealt = "part long, of long, hashes binary, counts binary"

    def deal(batches):
        for b in batches:
            for of, raw, counted in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                h, n = np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64), _unpack(counted, "<i4")
                if not len(h):
                    continue
                part = h // width if width else np.zeros(len(h), np.uint64)
                found, begin = np.unique(part, return_index=True)
                for p, lo, hi in zip(found.tolist(), begin, [*begin[1:], len(h)], strict=True):
                    yield _batch(dealt, [[p], [of], [_pack(np.diff(h[lo:hi], prepend=np.uint64(0)), "<u8")], [_pack(n[lo:hi], "<i4")]])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64) for raw in pdf["hashes"]]
        n = np.concatenate([_unpack(raw, "<i4") for raw in pdf["counts"]])
        _, at = np.unique(np.concatenate(h), return_inverse=True)
        totals = np.bincount(at, n).astype(np.int64)
        split = np.split(totals[at], np.cumsum([len(x) for x in h])[:-1])
        out = pd.DataFrame({"of": pdf["of"], "part": pdf["part"], "counts": [_pack(x, "<i8") for x in split]})
        out["known"] = [int((totals > 0).sum())] + [0] * (len(out) - 1)
        out["total"] = [int(totals.sum())] + [0] * (len(out) - 1)
        return out

    rows = chunks.select("chunk", "hashes", "counts").mapInArrow(deal, dealt).repartition(ranges, "part")
    return rows.groupBy("part").applyInPandas(add, "of long, part long, counts binary, known long, total long")


def _tables(chunks: DataFrame, n_ids: int) -> attention.Tables:
    """Counts of subwords, then of pairs of a context and a subword: at most n_ids and CONTEXTS * n_ids rows reach the driver."""
    spark = chunks.sparkSession
    counts = np.zeros(n_ids, np.int64)
    got = chunks.select(F.posexplode("subwords").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    for r in got.toPandas().itertuples():
        counts[r.id] = r.n
    rank, size = attention.ranked(counts)
    ranks = spark.sparkContext.broadcast(rank)
    contexts = min(size, attention.CONTEXTS)

    def cells(batches):
        for b in batches:
            for pairs, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = np.cumsum(_unpack(pairs, "<i8"))
                before = np.minimum(ranks.value[p >> 20], contexts - 1).astype(np.int64)
                found, at = np.unique(before * size + ranks.value[p & ((1 << 20) - 1)], return_inverse=True)
                sums = np.bincount(at, _unpack(n, "<i4"), len(found)).astype(np.int64)
                yield _batch("cell long, n long", [found, sums])

    got = chunks.select("pairs", "pair_counts").mapInArrow(cells, "cell long, n long")
    got = got.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(contexts * size, np.float32)
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    return attention.tables(counts, table.reshape(contexts, size))


def shard_of(ids: np.ndarray, none: np.ndarray, hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each document: by its id, or without one by its contents' hash and how often these came before."""
    keys, met = ids.copy(), {}
    for k in np.flatnonzero(none).tolist():
        h = int(hashes[k])
        met[h] = met.get(h, -1) + 1
        keys[k] = h ^ met[h]
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(shards)).astype(np.int64)


def _shards(chunks: DataFrame, tables: attention.Tables, end: int, n_learnt: int) -> DataFrame:
    """shard, stream: the buckets of each shard's training documents, in order of their ids, after one end token."""
    shards = max(1, round(n_learnt / SHARD_TOKENS))
    shipped = chunks.sparkSession.sparkContext.broadcast(tables.bucket)
    dealt = "shard long, doc_ids binary, no_id binary, hashes binary, sizes binary, buckets binary"

    def deal(batches):
        for b in batches:
            for row in b.to_pandas().itertuples():
                s, learnt = _Streams(row, end), _unpack(row.learnt, "u1") > 0
                rows = np.flatnonzero(learnt)
                begin = np.cumsum(s.lengths) - s.lengths
                hashes = np.fromiter(
                    (xxhash.xxh64_intdigest(s.ids[begin[d] : begin[d] + s.lengths[d]].tobytes()) >> 1 for d in rows), np.int64, len(rows)
                )
                ids, none = _unpack(row.doc_ids, "<i8")[rows], _unpack(row.no_id, "u1")[rows] > 0
                of = shard_of(ids, none, hashes, shards)
                for shard in np.unique(of):
                    mine = np.flatnonzero(of == shard)
                    parts = [s.ids[begin[d] : begin[d] + s.lengths[d]] for d in rows[mine]]
                    yield _batch(
                        dealt,
                        [[shard], [_pack(ids[mine], "<i8")], [_pack(none[mine], "u1")], [_pack(hashes[mine], "<i8")],
                         [_pack(s.lengths[rows[mine]], "<i4")], [_pack(shipped.value[np.concatenate(parts)], "<i4")]],
                    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        docs: list[tuple] = []
        for r in pdf.itertuples():
            sizes, flat = _unpack(r.sizes, "<i4"), _unpack(r.buckets, "<i4")
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            keys = (_unpack(r.no_id, "u1"), _unpack(r.doc_ids, "<i8"), _unpack(r.hashes, "<i8"))
            docs += zip(*(k.tolist() for k in keys), parts, strict=True)
        docs.sort(key=lambda d: d[:3])
        stream = np.concatenate([[shipped.value[end]], *(d[3] for d in docs)])
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "stream": [_pack(stream, "<i4")]})

    columns = ["doc_ids", "no_id", "learnt", "sizes", "codes", "word_sizes", "word_ids"]
    rows = chunks.where("n_learnt > 0").select(*columns).mapInArrow(deal, dealt).repartition(shards, "shard")
    return rows.groupBy("shard").applyInPandas(join, "shard long, stream binary")


def round_windows(stream: np.ndarray, round_: int) -> np.ndarray:
    """The windows of a shard's stream that belong to a round."""
    return attention.cut(stream)[round_::ROUNDS]


def _train(shards: DataFrame, tables: attention.Tables) -> np.ndarray:
    sc = shards.sparkSession.sparkContext
    shipped = sc.broadcast(tables)
    flat = attention.initial(tables)
    for round_ in range(ROUNDS):
        now = sc.broadcast(flat)

        def run(batches, round_=round_, now=now):
            n, total = 0, np.zeros(len(now.value))
            for b in batches:
                for raw in b.column(0):
                    windows = round_windows(_unpack(raw.as_py(), "<i4"), round_)
                    new = attention.train_windows(now.value, shipped.value, windows, RATE / (1 + round_), MIN_STEPS)
                    n, total = n + len(windows), total + new.astype(np.float64) * len(windows)
            if n:
                yield _batch("slot long, n long, flat binary", [[TaskContext.get().partitionId() % SUMS], [n], [total.tobytes()]])

        sums = shards.select("stream").mapInArrow(run, "slot long, n long, flat binary")
        sums = sums.repartition(SUMS, "slot").mapInArrow(_add, "n long, flat binary").collect()
        if sums:
            flat = (sum(np.frombuffer(r.flat) for r in sums) / sum(r.n for r in sums)).astype(np.float32)
    return flat


def _add(batches) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for b in batches:
        for k, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            n, total = n + k, total + np.frombuffer(raw)
    if n:
        yield _batch("n long, flat binary", [[n], [total.tobytes()]])


def lm_scores(
    docs: DataFrame, learnt: Column, vocab_path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10); learnt: true for documents to learn from."""
    spark = docs.sparkSession
    with open(vocab_path, encoding="utf-8") as f:
        vocabulary = parsed(f.read())
    end, n_ids = vocabulary.specials["<|endoftext|>"], len(vocabulary.token_bytes)
    chunks = stored(_chunks(docs, learnt, vocab_path, doc_id, text), "chunks")
    size = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_ends", "n_learnt"))
    ).first()
    totals = stored(_word_totals(chunks, size.n_words), "totals")
    words = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "total"))).first()
    n_ends, n_train, v = size.n_ends, words.total + size.n_ends, words.known + (size.n_ends > 0)
    tables = _tables(chunks, n_ids)
    shards = stored(_shards(chunks, tables, end, size.n_learnt), "shards")
    model = spark.sparkContext.broadcast((_train(shards, tables), tables))

    def score(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        out = []
        flat, t = model.value
        for row in rows.itertuples():
            s = _Streams(row, end)
            parts = [_unpack(raw, "<i8") for raw in counted.sort_values("part")["counts"]]
            count = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            norm = np.log10(n_train + 0.5 * (v + 1))
            logs = np.log10(count + 0.5) - norm
            k = len(s.sizes)
            base = np.bincount(s.doc, logs[s.codes], k) + np.log10(n_ends + 0.5) - norm
            known = np.bincount(s.doc, count[s.codes] > 0, k).astype(np.int64) + (n_ends > 0)
            columns = {
                "doc_id": pd.arrays.IntegerArray(_unpack(row.doc_ids, "<i8"), _unpack(row.no_id, "u1") > 0), "n_tokens": s.sizes + 1, "n_known": known, "train_tokens": n_train,
                "base_score": base, "score": attention.score_streams(flat, t, s.ids, s.lengths, end) / np.log(10),
            }
            out.append(pd.DataFrame(columns))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id"])

    # a task for each chunk, however many there are
    tasks = max(1, size.chunks)
    blobs = chunks.select(F.col("chunk").alias("of"), "doc_ids", "no_id", "sizes", "codes", "word_sizes", "word_ids").repartition(tasks, "of")
    counted = totals.select("of", "part", "counts").repartition(tasks, "of")
    return (
        blobs.groupBy("of")
        .cogroup(counted.groupBy("of"))
        .applyInPandas(
            score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )
    )
