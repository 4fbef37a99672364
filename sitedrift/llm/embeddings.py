"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors lexicographically by their concatenated random hashes (signs of projections on random
directions) and compares neighbours in a bounded window of that order. A pass moves a byte for each component of a
vector, with the length of what rounding left: that bounds the cosine, so most pairs are decided, and the doubtful ones
that lie across components are verified on the vectors in double precision. Linked pairs of all passes are united. Equal
vectors collapse first. Within the components found, links are then counted exactly in
bounded blocks; pairs are never emitted.

A pair of cosine 0.9 shares a window in one pass with a chance of about 0.24 at 100,000 vectors, and each doubling of the
table costs about a sixth of that (measured at 64 dimensions, 25,000 to 400,000 random vectors). The number of passes follows from the number of distinct vectors, so that the chance
to miss such a pair stays at 2e-4 (24 passes at least, 32 at 100,000 vectors, 46 at 400,000). Then further passes are
made, ``PASSES_AT_ONCE`` at a time, until those of a time join no components: where many vectors are near each other but
not linked, a link's chance in a pass is much less than the formula has it.

Defined results: null or zero vectors and those with null or non-finite components link with nothing, nor do vectors
of different lengths; a window's ties are in order of ids; rows that repeat a vector are linked copies; other columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import UnionFind, connected_components
from .shared import partitions, stored

#: PASSES at least; MISS: chance aimed at to miss a pair of cosine 0.9 in all passes.
PASSES, HASHES, WINDOW, MISS = 24, 63, 96, 2e-4
#: Passes that are sorted by one job; bounds the rows shuffled at a time.
PASSES_AT_ONCE = 8
#: Vectors of a block when links are counted; a task holds two.
BLOCK = 128
#: Rows of a sorted partition aimed at.
PARTITION_ROWS = 20_000
SEED = 20240101


def usable(vector: str) -> Column:
    """True for vectors that can have a cosine."""
    inf = float("inf")
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def passes_for(n_vectors: int) -> int:
    """Passes after which a pair of cosine 0.9 is missed with a chance of MISS; see the module's text."""
    chance = min(0.3, 0.24 * 0.84 ** math.log2(max(n_vectors, 1) / 100_000))
    return max(PASSES, math.ceil(math.log(MISS) / math.log1p(-chance)))


def _unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of length 1. The largest component is brought to 1 first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(x: np.ndarray) -> list[bytes]:
    """Unit vectors in a byte for each component: scale, length of what rounding left (both float32), bytes."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1)
    head = np.stack([scale, (rest * 1.00001 + 1e-7).astype(np.float32)], 1)
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q, strict=True)]


def _decode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in float32, lengths of what rounding left)."""
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    head = np.ascontiguousarray(rows[:, :8]).view("<f4")
    return np.ascontiguousarray(rows[:, 8:]).view(np.int8) * head[:, :1], head[:, 1]


Pairs = list[tuple[int, int]]


def _near(x: tuple, y: tuple | None, threshold: float) -> tuple[Pairs, Pairs]:
    """(edges, doubtful pairs) of the decoded rows of x (and of y below it).

    The cosine of two rows lies within the sum of their rounding lengths of the product of their codes. Edges join the rows
    surely linked as their pairs do, at most one for each row; doubtful are the pairs of rows not joined so whose
    cosine may reach the threshold.
    """
    both, rest = x if y is None else (np.concatenate([a, b]) for a, b in zip(x, y, strict=True))
    n = len(x[0])
    about = both @ both.T
    slack = rest[:, None] + rest[None, :]
    slack += 3 * rest[:, None] * rest[None, :] + 1e-5
    linked, doubtful = about - slack >= threshold, about + slack >= threshold
    np.fill_diagonal(linked, False)
    if y is not None:
        linked[n:, n:] = doubtful[n:, n:] = False
    if not doubtful.any():
        return [], []
    label = np.arange(len(both))
    while linked.any():
        least = np.minimum(label, np.where(linked, label[None, :], len(both)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    i, j = np.nonzero(np.triu(doubtful, 1) & (label[:, None] != label[None, :]))
    return [(k, int(r)) for k, r in enumerate(label) if r != k], list(zip(i.tolist(), j.tolist(), strict=True))


def _passes(classes: DataFrame, first: int, count: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _unit([raw[i] for i in rows])
                reps, codes = pa.array([ids[i] for i in rows], pa.int64()), pa.array(_codes(x), pa.binary())
                for p in range(first, first + count):
                    directions = np.random.default_rng((SEED, p, int(size))).standard_normal((int(size), HASHES))
                    key = ((x @ directions > 0) @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), p), pa.int32()), pa.array(np.full(len(rows), size), pa.int32()),
                            pa.array(key), reps, codes,
                        ],
                        names=["pass", "size", "key", "rep", "code"],
                    )

    return classes.select("rep", "vec").mapInArrow(run, "pass int, size int, key long, rep long, code binary")


#: What a sorted partition gives: links and doubtful pairs (a, b), and at its ends the rows (order a, rep b) for the windows
#: that lie across two partitions.
LINK, DOUBT, LEFT, RIGHT = range(4)
FOUND = "kind int, seam int, a long, b long, pass int, code binary"


def _windows(rows: DataFrame, n: int, threshold: float, window: int) -> DataFrame:
    """FOUND rows of the sorted passes."""
    order = ["pass", "size", "key", "rep"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        part, joined, before, ends = TaskContext.get().partitionId(), UnionFind(), None, []
        held: list[tuple] = []
        first_rows: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal before
            links, doubts = [], []
            runs = np.flatnonzero([i == 0 or rows[i][:2] != rows[i - 1][:2] for i in range(len(rows))]).tolist()
            for lo, hi in zip(runs, runs[1:] + [len(rows)], strict=True):
                group = rows[lo:hi]
                reps, x = [r[3] for r in group], _decode([r[4] for r in group])
                tries = [(reps, _near(x, None, threshold))]
                if before is not None and before[0] == group[0][:2]:
                    tries.append((before[1] + reps, _near(before[2], x, threshold)))
                for names, (sure, doubtful) in tries:
                    links += [(names[i], names[j]) for i, j in sure if joined.union(names[i], names[j])]
                    doubts += [(names[i], names[j]) for i, j in doubtful]
                before = (group[0][:2], reps, x)
            doubts = [(a, b) for a, b in doubts if joined.find(a) != joined.find(b)]
            found = links + doubts
            kinds, none = [LINK] * len(links) + [DOUBT] * len(doubts), [0] * len(found)
            return _found(kinds, none, [a for a, _ in found], [b for _, b in found], none, [None] * len(found))

        for b in batches:
            fresh = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            first_rows += fresh[: window - len(first_rows)]
            held += fresh
            while len(held) >= window:
                now, held = held[:window], held[window:]
                ends = (ends + now)[-window:]
                yield block(now)
        if held:
            ends = (ends + held)[-window:]
            yield block(held)
        for kind, seam, rows in ((RIGHT, part - 1, first_rows), (LEFT, part, ends)):
            k = len(rows)
            if k:
                yield _found([kind] * k, [seam] * k, list(range(k)), [r[3] for r in rows], [r[0] for r in rows], [r[4] for r in rows])

    return ordered.mapInArrow(run, FOUND)


def _found(kind, seam, a, b, passes, code) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.array(x, t) for x, t in zip((kind, seam, a, b, passes, code), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "seam", "a", "b", "pass", "code"])


def _links(classes: DataFrame, n_classes: int, begin: int, passes: int, window: int, threshold: float) -> DataFrame:
    """kind LINK or DOUBT, a, b: what so many passes from number begin on found."""
    found = []

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(size=pdf["code"].map(len))
        for _, g in pdf.groupby(["pass", "size"], sort=True):
            left, right = (g[g["kind"] == k].sort_values("a") for k in (LEFT, RIGHT))
            if len(left) and len(right):
                names = [*left["b"], *right["b"]]
                pairs = _near(_decode(list(left["code"])), _decode(list(right["code"])), threshold)
                for kind, part in zip((LINK, DOUBT), pairs, strict=True):
                    out += [(kind, names[i], names[j]) for i, j in part]
        return pd.DataFrame(out, columns=["kind", "a", "b"], dtype="int64")

    for first in range(begin, begin + passes, PASSES_AT_ONCE):
        count = min(PASSES_AT_ONCE, begin + passes - first)
        total = n_classes * count
        n = max(-(-total // PARTITION_ROWS), min(partitions(classes.sparkSession), total // (8 * window)), 1)
        out = stored(_windows(_passes(classes, first, count), n, threshold, window), "windows")
        found.append(out.where(F.col("kind") <= DOUBT).select("kind", "a", "b"))
        found.append(out.where(F.col("kind") > DOUBT).groupBy("seam").applyInPandas(across, "kind int, a long, b long"))
    links = found[0]
    for x in found[1:]:
        links = links.unionAll(x)
    return links


def _verified(doubts: DataFrame, found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The doubtful pairs (a, b) of different components whose vectors are linked."""
    pairs = doubts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        of = found.select(F.col("rep").alias(end), F.col("component").alias(f"c{end}"))
        vec = classes.select(F.col("rep").alias(end), F.col("vec").alias(f"v{end}"))
        pairs = pairs.join(of, end, "left").hint("merge").join(vec, end)
    pairs = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "va", "vb")

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (_unit(t.column(c).to_pylist()) for c in (2, 3))
                good = pa.array((x * y).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(good)

    return pairs.mapInArrow(run, "a long, b long")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame | None:
    """found (rep, component) with the components joined that links (a, b) lie across; None if there are none."""
    for end in ("a", "b"):
        of = found.select(F.col("rep").alias(end), F.col("component").alias("c"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = stored(links.where("a <> b").distinct(), "links")
    if joined.isEmpty():
        return None
    moved = connected_components(joined)
    labels = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(labels, "component", "left").select("rep", F.coalesce("to", "component").alias("component"))
    new = moved.withColumnRenamed("node", "rep").join(found.select("rep"), "rep", "left_anti")
    return stored(old.unionByName(new), "found")


def _components(classes: DataFrame, n_classes: int, passes: int, window: int, threshold: float) -> DataFrame:
    """(rep, component) of linked vectors, after so many passes and then as many more as join components."""
    found, done = classes.sparkSession.createDataFrame([], "rep long, component long"), 0
    while True:
        links = stored(_links(classes, n_classes, done, passes, window, threshold), "links")
        sure = _merged(found, links.where(F.col("kind") == LINK).select("a", "b"))
        now = found if sure is None else sure
        doubts = _verified(links.where(F.col("kind") == DOUBT), now, classes, threshold)
        more = _merged(now, doubts)
        found = now if more is None else more
        if n_classes < 2 or (done and sure is None and more is None):
            return found
        done, passes = done + passes, PASSES_AT_ONCE


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """rep, n: copies of other vectors linked to each of the members (component, n_members, rep, copies, vec)."""
    n = F.ceil(F.col("n_members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"rep": [], "n": []}, dtype="int64")
        linked = _unit(list(x["vec"])) @ _unit(list(y["vec"])).T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"rep": x["rep"], "n": linked @ y["copies"].to_numpy()})
        sums = np.concatenate([linked @ y["copies"].to_numpy(), linked.T @ x["copies"].to_numpy()])
        return pd.DataFrame({"rep": [*x["rep"], *y["rep"]], "n": sums})

    parts = dealt.groupBy("component", "i", "j").applyInPandas(count, "rep long, n long")
    return parts.groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    passes: int | None = None,
    window: int = WINDOW,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept; see the module's text. passes: those before the further ones, by default
    as many as the number of vectors asks for."""
    good = usable(vector)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(good, F.col(vector).cast("array<double>")).alias("v"),
    )
    copies = (
        rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
        .groupBy("v")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )

    def pack(batches):
        for b in batches:
            vec = [np.asarray(v, np.float64).tobytes() for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(vec, pa.binary())], names=["v", "rep", "copies", "vec"]
            )

    classes = stored(copies.mapInArrow(pack, "v array<double>, rep long, copies long, vec binary"), "vectors")
    n_classes = classes.count()
    found = _components(classes, n_classes, passes_for(n_classes) if passes is None else passes, window, threshold)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    members = found.join(sizes, "component").join(classes.select("rep", "copies", "vec"), "rep")
    counted = _count_links(members, threshold)

    labels = (
        classes.select("v", "rep", "copies")
        .join(found, "rep", "left")
        .join(counted, "rep", "left")
        .select(
            "v",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return rows.join(labels, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
