"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts, about.
LOCAL_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as ties of each node to the least that these edges alone connect it with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ties = np.array([(n, root(n)) for n in list(parent)], np.int64).reshape(-1, 2)
    ties = ties[ties[:, 0] != ties[:, 1]]
    yield pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1])], ["a", "b"])


def _least(edges: DataFrame) -> DataFrame:
    """For every a, the least of a and its neighbours b; partial minima come before the shuffle, so hubs are no hot spot."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, label: the least node of every node's component, for nodes that have an edge.

    Each task first contracts its share of the edges. Then large-star and small-star steps follow in turn, until nothing
    changes, however many rounds that takes: their number grows with the logarithm of the longest path that is left. Where all
    edges fit one share, the contraction is already the answer. Repeated edges, loops and nulls do not matter (null ends are
    dropped); no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    shares = -(-now.count() // LOCAL_EDGES) or 1
    now = cut(now.coalesce(shares).mapInArrow(_contract, "a long, b long"))
    state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while shares > 1 and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every greater neighbour is tied to the least one.
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lesser neighbours are tied to the least of them.
        small = large.join(_least(large), "a")
        tied = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(tied)
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            break
    roots = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("label")))
