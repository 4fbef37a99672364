"""Near-duplicates of word shingle sets by SuperMinHash, banding, verification on full sets and union-find.

Equal sets collapse first, so copies cost one row each from then on. Signatures come from SuperMinHash: every shingle
draws a rank for each level of its own random permutation of the positions, and a set stops at the first level whose
ranks can't lower any of its positions. Documents that share a band are candidates:

1. Each document is verified against the bucket's end (smallest or largest id) with which it shares most bands.
2. Its pairs with other ends go on where they would join two components and the signatures agree enough.
3. In larger buckets that still hold several components, all pairs of different components are judged in bounded
   blocks: first by signature, and those that pass by their full sets. Pairs are never emitted, only links that join
   components.

Defined results: words are lower-cased (A-Z only); a text with fewer words than a shingle has is one shingle; null,
empty and wordless texts have no shingles and no links; each row counts by itself, so rows that repeat a text are
copies, also under one id, and different texts under one id are different documents; rows without an id link like others,
name no component (component_id is null if no row of it has an id) and aren't kept; other columns are left out; an
empty table gives no rows. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import UnionFind, connected_components
from .shared import stored, unused
from .word_ids import lower_ascii

POSITIONS = 128
#: A pair whose signatures agree on this much less than the threshold isn't verified (four standard deviations).
SLACK = 0.14
#: Members of a block; a task holds two blocks at a time.
BLOCK = 256
#: Rows of blocks that a task is to judge.
TASK_ROWS = 4_000
#: Shingles whose signatures are computed together.
CHUNK = 150_000
CACHE_WORDS = 250_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES: list[_Hashes] = []


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    if not _HASHES or len(_HASHES[0]) > CACHE_WORDS:
        _HASHES[:] = [_Hashes()]
    h = np.fromiter(map(_HASHES[0].__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _GOLD + h[i : i + n])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int = POSITIONS) -> np.ndarray:
    """Signatures (len(sets), m) of uint32: level in the upper bits, the random fraction below it."""
    low = 32 - int(m - 1).bit_length()
    fraction = np.uint64(64 - low)
    sig = np.full(len(sets) * m, 2**32 - 1, np.uint32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm: np.ndarray | None = None
    for level in range(m):
        r = mix(flat + np.uint64((int(_GOLD) * (level + 1)) & (2**64 - 1)))
        at = level + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)
        n = np.arange(len(flat))
        if level:
            place = perm[n, at].astype(np.int64)
            perm[n, at] = perm[:, level]
        else:
            place, first = at, at
        rank = ((r >> fraction) | np.uint64(level << low)).astype(np.uint32)
        np.minimum.at(sig, owner * m + place, rank)
        open_docs = sig.reshape(-1, m).max(1) >= (level + 1) << low
        live = open_docs[owner]
        if not live.any():
            break
        if level == 0:
            flat, owner, first = flat[live], owner[live], first[live]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(flat), 1))
            n = np.arange(len(flat))
            perm[n, first] = 0
        elif not live.all():
            flat, owner, perm = flat[live], owner[live], perm[live]
    return sig.reshape(-1, m)


def band_rows(percent: int) -> int:
    """Positions of a band. Of pairs just at the threshold, bands of 6 miss one in 20,000 at 0.85, bands of 5 at 0.8."""
    return 6 if percent >= 85 else 5


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) of int64: equal where the rows of that band are."""
    bands = sig.shape[1] // rows
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key * _GOLD + sig[:, r].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


def sketches(docs: DataFrame, k: int, doc_id: str, text: str, rows_of_band: int) -> DataFrame:
    """A row per document: node (its number), doc_id, n_shingles, set_key (128-bit hash of the set), bands, sig (a byte for
    each position), body (deflated text, a third of its hashed shingles). node numbers hold once the rows are stored."""

    def run(batches):
        node = TaskContext.get().partitionId() << 36
        for b in batches:
            rows, held = [], 0

            def flush(rows: list) -> pa.RecordBatch:
                nonlocal node
                sig = superminhash([s for _, s, _ in rows])
                keys = band_keys(sig, rows_of_band)
                small = mix(sig.astype(np.uint64)).astype(np.uint8)
                node += len(rows)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(node - len(rows), node), pa.int64()),
                        pa.array([i for i, _, _ in rows], pa.int64()),
                        pa.array([len(s) for _, s, _ in rows], pa.int64()),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) for _, s, _ in rows], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                        pa.array([x for _, _, x in rows], pa.binary()),
                    ],
                    names=["node", "doc_id", "n_shingles", "set_key", "bands", "sig", "body"],
                )

            for i, t in zip(b.column(0), b.column(1), strict=True):
                body = t.as_py() or ""
                s = shingles(body, k)
                rows.append((i.as_py(), s, zlib.compress(body.encode(), 1)))
                held += len(s)
                if held >= CHUNK:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "node long, doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary, body binary"
    )


def body_shingles(body: bytes, k: int) -> np.ndarray:
    return shingles(zlib.decompress(body).decode(), k)


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; texts: node, body."""
    joined = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a")
    joined = joined.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b")

    def run(batches):
        for t in batches:
            keep = []
            for ta, tb in zip(t.column(2), t.column(3), strict=True):
                x, y = (body_shingles(s.as_py(), k) for s in (ta, tb))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(similar(inter, len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough for their sets to be similar."""
    sigs = reps.select("node", "sig")
    joined = pairs.hint("merge").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    joined = joined.hint("merge").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (
                    np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in (2, 3)
                )
                good = pa.array((x == y).mean(1) >= percent / 100 - SLACK)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(good)

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _candidates(x: pd.DataFrame, y: pd.DataFrame, same: bool, band: int, percent: int) -> np.ndarray:
    """Index pairs of two blocks of one bucket to verify: of different components, sizes that allow the similarity,
    no earlier common band, and signatures that agree enough; most alike first."""
    nx, ny = x["n_shingles"].to_numpy(), y["n_shingles"].to_numpy()
    ok = x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
    ok &= 100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :])
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    i, j = np.nonzero(ok)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    sx = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x), -1)
    sy = np.frombuffer(b"".join(y["sig"]), np.uint8).reshape(len(y), -1)
    kx, ky = np.stack(list(x["bands"])), np.stack(list(y["bands"]))
    agree = np.empty(len(i))
    for at in range(0, len(i), 20_000):
        p, q = i[at : at + 20_000], j[at : at + 20_000]
        agree[at : at + 20_000] = (sx[p] == sy[q]).mean(1)
        if band:
            agree[at : at + 20_000][(kx[p, :band] == ky[q, :band]).any(1)] = 0
    good = np.flatnonzero(agree >= percent / 100 - SLACK)
    good = good[np.argsort(-agree[good], kind="stable")]
    return np.stack([i[good], j[good]], 1)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shared vocabulary."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    places = []
    for flat, sets in ((flat_a, a), (flat_b, b)):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
    for lo in range(0, len(both), 4096):
        part = []
        for (row, at), sets in zip(places, (a, b), strict=True):
            one = np.zeros((len(sets), min(4096, len(both) - lo)), np.float32)
            inside = (at >= lo) & (at < lo + 4096)
            one[row[inside], at[inside] - lo] = 1
            part.append(one)
        out += part[0] @ part[1].T
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of a bucket (key, component, n_members, top: size and name of its largest component) dealt over pairs of
    blocks (i <= j) by the hash of their number.

    Only different components are to meet, so members of the largest one aren't dealt against each other: blocks of the
    others (numbered from 0) meet all blocks, those of the largest (numbered after them) only these.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    of_top = F.col("component") == F.col("top.component")
    others, top = blocks(F.col("n_members") - F.col("top.n")), blocks(F.col("top.n"))
    place = lambda n: F.pmod(F.xxhash64("node", "key"), n.cast("long")).cast("int")
    own = F.when(of_top, others + place(top)).otherwise(place(others))
    met = F.sequence(F.lit(0), F.when(of_top, others - 1).otherwise(others + top - 1))
    pairs = F.transform(met, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return members.withColumn("own", own).withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p", "top")


def _judge(pdf: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values("node", kind="stable")
    x = pdf[pdf["own"] == i]
    y = x if i == j else pdf[pdf["own"] == j]
    key = pdf["key"].iloc[0]
    band = int(np.flatnonzero(np.asarray(pdf["bands"].iloc[0]) == key)[0])
    return x, y, _candidates(x, y, i == j, band, percent) if len(x) and len(y) else np.zeros((0, 2), np.int64)


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents with 100 * intersection >= percent * union are linked."""
    sketch = stored(sketches(docs, k, doc_id, text, band_rows(percent)), "sketches")
    classes = sketch.where("n_shingles > 0").groupBy("set_key").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least"))
    classes = stored(classes, "classes")
    firsts = classes.select(F.col("rep").alias("node")).hint("merge")
    reps = sketch.select("node", "n_shingles", "bands", "sig").where("n_shingles > 0").join(firsts, "node", "left_semi")
    reps = stored(reps, "reps")

    exploded = reps.select("node", "n_shingles", F.explode("bands").alias("key"))
    ends = exploded.groupBy("key").agg(
        F.min(F.struct("node", "n_shingles")).alias("lo"),
        F.max(F.struct("node", "n_shingles")).alias("hi"),
        F.count(F.lit(1)).alias("n_members"),
    )
    members = stored(exploded.join(ends.where("n_members > 1").hint("merge"), "key"), "members")
    wanted = members.select("node").distinct().hint("merge")
    texts = stored(sketch.select("node", "body").join(wanted, "node", "left_semi"), "bodies")

    def pair(end: str) -> DataFrame:
        fits = F.lit(100) * F.least("n_shingles", f"{end}.n_shingles") >= F.lit(percent) * F.greatest(
            "n_shingles", f"{end}.n_shingles"
        )
        return members.where(fits & (F.col("node") != F.col(f"{end}.node"))).select(
            "node", F.col(f"{end}.node").alias("end")
        )

    shared = stored(pair("lo").unionAll(pair("hi")).groupBy("node", "end").count(), "shared")
    best = shared.groupBy("node").agg(F.max(F.struct("count", "end")).alias("best"))
    pairs = stored(best.select(F.col("node").alias("a"), F.col("best.end").alias("b")), "pairs")
    links = stored(verify(pairs, texts, k, percent), "links")
    found = connected_components(links)

    later = shared.select(F.col("node").alias("a"), F.col("end").alias("b"))
    later = later.join(pairs.hint("merge"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        later = later.hint("merge").join(found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    later = later.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    later = stored(_alike(later, reps, percent), "later")
    links = links.unionAll(stored(verify(later, texts, k, percent), "links"))
    found = connected_components(links)

    large = members.where("n_members > 2").select("key", "node", "n_members")
    labelled = large.hint("merge").join(found.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_members"), F.max(F.struct("n", "component")).alias("top")
    )
    rest = labelled.join(split.where("parts > 1").drop("parts"), "key")
    rest = rest.hint("merge").join(reps.select("node", "n_shingles", "bands", "sig"), "node")
    rest = stored(_blocks(rest), "rest")
    # dealt by rows: their bytes are few, but comparing blocks takes time
    dealt = max(1, -(-rest.count() // TASK_ROWS)), "key", "i", "j"

    def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, at = _judge(pdf, percent)
        ids = np.union1d(x["node"].to_numpy()[at[:, 0]], y["node"].to_numpy()[at[:, 1]])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "i": pdf["i"].iloc[0], "j": pdf["j"].iloc[0], "node": ids})

    alive = rest.repartition(*dealt).groupBy("key", "i", "j").applyInPandas(survivors, "key long, i int, j int, node long")
    alive = stored(alive, "alive")

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, at = _judge(pdf, percent)
        out, joined = [], UnionFind()
        if len(at):
            a = [body_shingles(s, k) for s in x["body"]]
            b = a if y is x else [body_shingles(s, k) for s in y["body"]]
            table = _intersections(a, b) if len(at) > 400 else None
            cx, cy = x["component"].tolist(), y["component"].tolist()
            dx, dy = x["node"].tolist(), y["node"].tolist()
            for p, q in at.tolist():
                if joined.find(cx[p]) == joined.find(cy[q]):
                    continue
                inter = len(np.intersect1d(a[p], b[q], assume_unique=True)) if table is None else int(table[p, q])
                if similar(inter, len(a[p]), len(b[q]), percent):
                    joined.union(cx[p], cy[q])
                    out.append((dx[p], dy[q]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    last = rest.join(alive, ["key", "i", "j", "node"]).hint("merge").join(texts, "node")
    late = stored(last.repartition(*dealt).groupBy("key", "i", "j").applyInPandas(confirm, "a long, b long"), "late")
    labels = found if late.isEmpty() else connected_components(links.unionAll(late))

    # a class's component by its representative's number, then the smallest id of each component
    of_class = classes.hint("merge").join(labels, F.col("rep") == F.col("node"), "left").select(
        "set_key", "least", F.coalesce("component", "rep").alias("component")
    )
    of_class = stored(of_class, "classes")
    named = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.hint("merge").join(named, "component").select("set_key", "component_id")
    return (
        sketch.select("set_key", "doc_id", "n_shingles")
        .join(of_class, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, their own columns, that are the first of their component: exactly one row of each.

    First is the smallest id, rows without one after all others; of equal ids any one row. Rows without words are
    components of their own. The rows are stored once with a number, so ids may repeat or be missing.
    """
    number = unused(docs, "row")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, k, percent, number, text).select(F.col("doc_id").alias("n"), F.col("component_id").alias("c"))
    ids = rows.select(F.col(number).alias("n"), F.col(doc_id).alias("id")).hint("merge").join(found, "n")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    first = ids.groupBy("c").agg(F.min(order).alias("m")).select(F.col("m.n").alias(number))
    return rows.join(first.hint("merge"), number, "left_semi").select(*(f"`{c}`" for c in docs.columns))
