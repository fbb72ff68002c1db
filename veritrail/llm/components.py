"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Edges, of 16 bytes each, that one task may join by itself.
SMALL = 200_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of all edges of one partition, by union-find."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for batch in batches:
        for a, b in zip(np.asarray(batch.column(0)).tolist(), np.asarray(batch.column(1)).tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node, component`` (the smallest node) for the nodes of ``a, b`` edges between longs.

    Up to ``small`` edges are joined in one task. More of them take large-star and small-star
    steps in turn (Kiveris et al. 2014) until no edge changes: each is one shuffle of the edges,
    every round is written out, and the edges stay distributed. Both give the same rows.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    if edges.count() <= small:
        return cut(edges.coalesce(1).mapInArrow(_join, "node long, component long"), "components")
    return _by_stars(edges)


def _by_stars(edges: DataFrame) -> DataFrame:
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        before = _signature(now)
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        if _signature(now) == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).head()
    return tuple(row)
