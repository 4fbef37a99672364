"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents are dealt into shards of about equal numbers of entries. An entry is a term with a level: a term that occurs
tf times enters all levels up to tf's (``LEVELS``). A document's signature is a Bloom filter of its entries; a shard keeps
its signatures as slices, one bitmap over its documents for each bit. A term's bitmap is the conjunction of its slices:
it holds every document that has the entry, and a few others.

Search: a term's highest level whose bitmap has a document bounds tf there from above, and with it what the term adds to
the score; the weighted sum of slices over an item's terms bounds the document's score. The documents of the highest
bounds are scored exactly first. Every document whose bound doesn't fall behind the last of an item's best so far is then scored
exactly, on its whole text, and only those; so the result is that of scoring all documents.

The index is a map over the texts, kept in the shared folder. Exact document frequencies of an item's terms are
counted in the same pass (or, from the second block of items on, in one of their own). Items are taken in blocks of bounded expected size, so what is broadcast
doesn't grow with them.

Defined results: null text and text without terms match nothing and aren't counted; an item without terms has no rows;
rows that repeat an id are documents of their own, those without an id come last of equal scores; repeated items
are answered each; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_folder, stored
from .word_ids import lower_ascii

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Least tf of each level. A term of a level and not of the next occurs less often than the next's tf.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 1024])
#: Bits of a signature for each entry at least, bits set for an entry, and the range of a signature's bits (powers of two).
BITS, HASHES, FEWEST, MOST = 12, 3, 9, 22
#: Bits and documents of a shard at most (eight documents at least).
SHARD_BITS, SHARD_DOCS = 1 << 22, 1024
#: Bytes of a row group of the index, so that few shards are decoded at a time.
ROW_GROUP = 16 << 20
#: Items, and characters of items, that a block has in expectation.
BLOCK_ITEMS, BLOCK_CHARS = 256, 1 << 18
#: Documents of the highest bounds that are scored for a first threshold.
FIRST = 16
#: Candidates that are sent to all tasks at most, about 100 bytes each. If there are more, texts are shuffled to them.
SENT = 200_000
#: Distinct terms whose bits a task keeps.
HELD_TERMS = 300_000
SHARD = "kind int, bits int, ids binary, lengths binary, slices binary, term int, n long"
SLICES, FREQUENCY, TOTALS = range(3)
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[str]:
    return TERM.findall(lower_ascii(text)) if text else []


def hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in found), np.uint64, len(found))


def positions(term_hash: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each entry in signatures of 2^bits."""
    mixed = (term_hash ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    step = (mixed * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return ((mixed[:, None] + k * step[:, None]) >> np.uint64(64 - bits)).astype(np.int64)


class Shards:
    """Open shards by length of signature."""

    def __init__(self):
        self.open: dict[int, tuple[list, list, list, list]] = {}
        self.known: dict[str, int] = {}

    def add(self, doc_id: int | None, counts: Counter) -> tuple[int, tuple] | None:
        """The shard that this document closes, if any."""
        if len(self.known) > HELD_TERMS:
            self.known.clear()
        fresh = [t for t in counts if t not in self.known]
        self.known.update(zip(fresh, hashes(fresh).tolist(), strict=True))
        h = np.fromiter(map(self.known.__getitem__, counts), np.uint64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        reach = np.searchsorted(LEVELS, tf, side="right")
        level = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        bits = min(MOST, max(FEWEST, math.ceil(math.log2(BITS * len(level)))))
        shard = self.open.setdefault(bits, ([], [], [], []))
        for part, x in zip(shard, (doc_id, int(tf.sum()), np.repeat(h, reach), level), strict=True):
            part.append(x)
        full = len(shard[0]) >= min(SHARD_DOCS, max(8, SHARD_BITS >> bits))
        return (bits, self.open.pop(bits)) if full else None


def sliced(bits: int, shard: tuple[list, list, list, list]) -> dict:
    """The row of a shard: ids, lengths, and the bitmaps of its documents one after the other."""
    ids, lengths, hashed, levels = shard
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in levels])
    at = positions(np.concatenate(hashed), np.concatenate(levels), bits)
    set_bits = np.zeros((1 << bits, len(ids)), bool)
    set_bits[at, doc[:, None]] = True
    known = np.array([NO_ID if i is None else i for i in ids], np.int64)
    return {
        "kind": SLICES, "bits": bits, "ids": known.tobytes(), "lengths": np.array(lengths, np.int64).tobytes(),
        "slices": np.packbits(set_bits, axis=1).tobytes(), "term": None, "n": None,
    }


def _scan(docs: DataFrame, wanted: list[str], build: bool) -> DataFrame:
    """SHARD rows: slices of shards if build, documents that hold each wanted term, and totals (documents, terms)."""
    shipped = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(wanted)})
    names = [c.split()[0] for c in SHARD.split(", ")]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64())

    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def number(kind: int, term: int, n: int) -> dict:
        return dict.fromkeys(names) | {"kind": kind, "term": term, "n": n}

    def run(batches):
        shards, index = Shards(), shipped.value
        df, held, tokens = np.zeros(len(index), np.int64), 0, 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = Counter(terms(text.as_py()))
                if not counts:
                    continue
                held, tokens = held + 1, tokens + counts.total()
                df[[index[t] for t in index.keys() & counts.keys()]] += 1
                if build and (full := shards.add(doc_id, counts)):
                    yield batch([sliced(*full)])
        for rest in shards.open.items():
            yield batch([sliced(*rest)])
        found = [number(FREQUENCY, int(k), int(df[k])) for k in np.flatnonzero(df)]
        yield batch([*found, number(TOTALS, 0, held), number(TOTALS, 1, tokens)])

    return docs.mapInArrow(run, SHARD)


@dataclass
class Block:
    """Items of a search at one time: the terms of all, their weights, and (item, term) pairs in order of items."""

    rows: list[int]
    terms: list[str]
    weights: np.ndarray
    pair_item: np.ndarray
    pair_term: np.ndarray
    n: int
    total: int

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of these lengths."""
        return np.array([10 + 90 * int(k) * self.n // self.total for k in lengths], np.int64)


#: gain() stays below it.
MOST_GAIN = 1_000_000


def gain(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What a unit of weight adds to a score."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bounds(block: Block, bits: int, lengths: np.ndarray, slices: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Upper bounds (item, document) of a shard's scores."""
    n, m = len(lengths), block.norm(lengths)
    out, below = np.zeros((len(block.rows), n), np.int64), np.zeros(n, np.int64)
    active, before = np.arange(len(block.terms)), None
    for k in range(len(LEVELS)):
        at = positions(hashed[active], np.full(len(active), k), bits)
        maps = slices[at[:, 0]]
        for h in range(1, HASHES):
            maps &= slices[at[:, h]]
        if before is not None:
            maps &= before  # a term of this level is one of the level below
        held = maps.any(1)
        active, before = active[held], maps[held]
        if not len(active):
            break
        row = np.full(len(block.terms), -1)
        row[active] = np.arange(len(active))
        pairs = np.flatnonzero(row[block.pair_term] >= 0)
        term, item = block.pair_term[pairs], block.pair_item[pairs]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        has = np.unpackbits(before[row[term]], axis=1, count=n)
        sums = np.add.reduceat(has * block.weights[term, None], first, axis=0)
        rise = gain(int(LEVELS[k + 1]) - 1, m) if k + 1 < len(LEVELS) else np.full(n, MOST_GAIN)
        out[item[first]] += sums * (rise - below)
        below = rise
    return out


def _candidates(index: DataFrame, block: Block, depth: int, least: list[tuple[int, int]] | None = None) -> DataFrame:
    """(item, doc_id): of each task and item the depth highest bounds, or, with least (score, doc_id) of each item, all
    whose bound doesn't come after it. doc_id is null for documents without an id. With bound, where least isn't given."""
    shipped = index.sparkSession.sparkContext.broadcast((block, least))

    def run(batches):
        block, least = shipped.value
        hashed = hashes(block.terms)
        best: list[list[tuple[int, int]]] = [[] for _ in block.rows]
        for b in batches:
            for bits, ids, lengths, slices in zip(*(b.column(k) for k in range(4)), strict=True):
                bits, ids = bits.as_py(), np.frombuffer(ids.as_py(), np.int64)
                rows = np.frombuffer(slices.as_py(), np.uint8).reshape(1 << bits, -1)
                bound = bounds(block, bits, np.frombuffer(lengths.as_py(), np.int64), rows, hashed)
                out = []
                for k, row in enumerate(bound):
                    if least is None:
                        top = np.flatnonzero(row > 0)
                        if len(top) > depth:
                            top = top[np.lexsort((ids[top], -row[top]))[:depth]]
                        best[k] = sorted([*best[k], *((-int(row[i]), int(ids[i])) for i in top)])[:depth]
                    else:
                        score, last = least[k]
                        keep = (row > score) | ((row == score) & (ids <= last)) if score else row > 0
                        out += [(k, int(ids[i]), 0) for i in np.flatnonzero(keep)]
                if out:
                    yield _named(out)
        out = [(k, i, -minus) for k, found in enumerate(best) for minus, i in found]
        if out:
            yield _named(out)

    rows = index.where(F.col("kind") == SLICES).select("bits", "ids", "lengths", "slices")
    got = rows.mapInArrow(run, "item int, doc_id long, bound long")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _named(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "bound"])


def _scored(docs: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """item, doc_id, score above 0 of the documents named by pairs (item, doc_id), on their whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    pairs = stored(pairs.select("item", "doc_id"), "candidates")
    few = pairs.count() <= SENT
    asked = pairs.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("items"))
    asked = F.broadcast(asked) if few else asked
    rows = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "items")

    def run(batches):
        block = shipped.value
        index = {t: k for k, t in enumerate(block.terms)}
        begin = np.searchsorted(block.pair_item, np.arange(len(block.rows) + 1))
        tf = np.zeros(len(index), np.int64)
        for b in batches:
            out = []
            for doc_id, text, items in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                counts = Counter(terms(text.as_py()))
                found = index.keys() & counts.keys()
                at = [index[t] for t in found]
                tf[at] = [counts[t] for t in found]
                m = block.norm(np.array([counts.total()]))[0]
                adds = block.weights * gain(tf, m)
                for k in items:
                    if score := int(adds[block.pair_term[begin[k] : begin[k + 1]]].sum()):
                        out.append((k, doc_id, score))
                tf[at] = 0
            yield _named(out).rename_columns(["item", "doc_id", "score"]) if out else pa.RecordBatch.from_pylist([], SCORED)

    return rows.mapInArrow(run, "item int, doc_id long, score long")


SCORED = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _best(rows: DataFrame, by: str, count: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _block(items: list, scanned: DataFrame) -> Block | None:
    """Weights of the items (row, terms); None where no document or item has a term."""
    wanted = sorted({t for _, found in items for t in found})
    totals = {r["term"]: r["n"] for r in scanned.where(F.col("kind") == TOTALS).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = totals.get(0, 0), totals.get(1, 0)
    # a number for each term of the block
    held = scanned.where(F.col("kind") == FREQUENCY).groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in held}
    if not df:
        return None
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(wanted))]
    number = {t: k for k, t in enumerate(wanted)}
    pairs = [(i, number[t]) for i, (_, found) in enumerate(items) for t in sorted(found)]
    item, term = np.array(pairs, np.int64).reshape(-1, 2).T
    return Block([r for r, _ in items], wanted, np.array(weights, np.int64), item, term, n, total)


def _blocks(items: DataFrame) -> Iterator[list]:
    """[(item_id, terms)] of each block of items, which are dealt by hash of a number of theirs."""
    path = fresh_folder(items.sparkSession, "items")
    items.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    kept = items.sparkSession.read.parquet(path)
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    count = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    for k in range(count):
        rows = kept.where(F.pmod(F.xxhash64("row"), F.lit(count)) == k).select("item_id", "text").collect()
        found = [(r["item_id"], set(terms(r["text"]))) for r in rows]
        yield [x for x in found if x[1]]


def search(
    docs: DataFrame,
    items: DataFrame,
    count: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the count best documents for each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    schema = "item_id long, rank int, doc_id long, score long"
    out, index = spark.createDataFrame([], schema), None
    for asked in _blocks(items):
        if not asked:
            continue
        folder = fresh_folder(spark, "slices")
        wanted = sorted({t for _, found in asked for t in found})
        _scan(docs, wanted, build=index is None).write.option("parquet.block.size", ROW_GROUP).parquet(folder)
        scanned = spark.read.schema(SHARD).parquet(folder)
        index = scanned if index is None else index
        block = _block(asked, scanned)
        if block is None:
            continue
        depth = max(FIRST, count)
        first = _best(_candidates(index, block, depth), "bound", depth)
        # count rows for each item of the block at most
        best = _best(_scored(docs, first, block), "score", count).where(F.col("rank") == count).collect()
        last = {r["item"]: (r["score"], NO_ID if r["doc_id"] is None else r["doc_id"]) for r in best}
        least = [last.get(k, (0, 0)) for k in range(len(block.rows))]
        found = _best(_scored(docs, _candidates(index, block, depth, least), block), "score", count)
        # the items of the block
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block.rows)], "item int, item_id long")
        rows = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(rows)
    return out
