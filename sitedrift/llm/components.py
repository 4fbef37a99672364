"""Connected components of an edge table by contraction, and a union-find for use inside a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: At most so many edges (16 bytes each) are finished by one task; more are contracted.
FINISH = 100_000


class UnionFind:
    """Sets of hashable items; the smallest item names a set."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def union(self, a, b) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connected_components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node of its own.

    Each round gives the nodes a random order (a hash of node and round), points every node to the first of itself and
    its neighbours, and contracts the edges along that. As the order is a new one in each round, whatever the numbering,
    the nodes left are at most about half of those before (a chain keeps half, denser graphs fewer), so rounds are
    logarithmic. What is left of at most ``finish`` edges goes through a union-find in one task. Labels are
    composed from the last, smallest, round back, and the smallest node of each component is found at the end.

    Rounds are stored, so that lineage stays short and a lost executor costs no more than one. A node with very many
    edges is one key: its first neighbour is pre-aggregated, and Spark splits its joins. Null ends and loops are
    ignored; no edges give no rows.
    """
    live = stored(_apart(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    steps: list[DataFrame] = []
    while (left := live.count()) > finish:
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("p"))
        first = both.groupBy(F.col("a").alias("u")).agg(F.min(order("b")).alias("m"))
        step = stored(first.select("u", F.least("m", order("u"))["p"].alias("p")), "step")
        steps.append(step)
        moved = live.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
        moved = moved.join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        live = stored(_apart(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    labels = _finish(live) if left else live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for step in reversed(steps):
        to = labels.select(F.col("node").alias("p"), "component")
        labels = step.join(to, "p", "left").select(F.col("u").alias("node"), F.coalesce("component", "p").alias("component"))
        labels = stored(labels, "labels")
    if not steps:
        return stored(labels, "components")
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return stored(labels.join(least, "component").select("node", F.col("least").alias("component")), "components")


def _finish(edges: DataFrame) -> DataFrame:
    def run(batches):
        sets = UnionFind()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.parent.setdefault(x, x)
                sets.parent.setdefault(y, y)
                sets.union(x, y)
        nodes = sorted(sets.parent)
        columns = [pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


def _apart(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, larger end first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
