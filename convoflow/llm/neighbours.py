"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes through the middle of the data, and keeps
the strings of its rows as a sorted array. A query goes down every tree to its longest matching prefix, which a binary search
finds beside its own place and whose length differs from tree to tree. Then it goes up all trees at once, a bit at a time from
the longest of these prefixes, a tree joining in when its own length is reached, until the rows under the prefixes are enough;
these are ranked by their exact distance.

Rows are dealt to blocks, each with a forest of its own over all its rows. The stated queries go to every block; a task builds
the forest of a block once and streams the queries past it in batches. So memory is that of a block and a batch, copies of one
vector are spread, and only the nearest ten of a query leave a task: the last choice among blocks is a window whose limit
applies before its shuffle. How many candidates are enough is fitted on a sample of at most SAMPLE vectors, against brute force
there. Queries meet all blocks, so work grows as rows times queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

TREES, BITS = 32, 60
BLOCK_ROWS = 16_384
SAMPLE, SAMPLE_QUERIES = 4_096, 128
#: Recall on the sample that the fit asks for, above the 0.9 that is promised of the whole.
RECALL = 0.96


class Forest:
    """Sorted arrays of hash strings over one block's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5):
        self.bits, self.n = bits, len(vectors)
        self.rng_seed, self.trees = seed, trees
        self.middle = np.median(vectors, axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], bits))
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows, the strings as numbers: first bit first."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        centred = vectors - self.middle
        return np.stack([((centred @ p) > 0) @ weights for p in self.planes])

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """trees x queries: the length of the longest prefix that a row of the tree shares with the query."""
        depth = np.zeros(codes.shape, np.int64)
        if not self.n:
            return depth
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], codes[t])
            for beside in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
                apart = (self.sorted[t][beside] ^ codes[t]).astype(np.float64)  # 60 bits: frexp may round up to the next power
                length = np.frexp(apart)[1]
                length -= (length > 0) & (self.sorted[t][beside] ^ codes[t] < np.left_shift(1, np.maximum(length - 1, 0)))
                depth[t] = np.maximum(depth[t], self.bits - length)
        return depth

    def candidates(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """For each query the places of rows under the longest prefixes that give `enough` rows, or all."""
        codes = self.codes(queries)  # trees x queries
        longest = self.descend(codes)
        low, high = np.zeros(codes.shape, np.int64), np.zeros(codes.shape, np.int64)
        start = longest.max(axis=0, initial=0)
        short = np.ones(len(queries), bool)  # queries that have not got enough
        for depth in range(int(start.max(initial=0)), -1, -1):  # up all trees at once
            drop = self.bits - depth
            for t in range(self.trees):
                live = np.flatnonzero(short & (longest[t] >= depth))
                prefix = codes[t, live] >> drop
                low[t, live] = np.searchsorted(self.sorted[t], prefix << drop)
                high[t, live] = np.searchsorted(self.sorted[t], (prefix + 1) << drop)
            short &= (high - low).sum(axis=0) < min(enough, self.trees * self.n)
            if not short.any():
                break
        out = []
        for q in range(len(queries)):
            held = np.zeros(self.n, bool)
            for t in range(self.trees):
                held[self.order[t, low[t, q] : high[t, q]]] = True
            out.append(np.flatnonzero(held))
        return out


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by score, then id."""
    if len(score) > k:
        near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))][:k]


def fit_enough(sample: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Candidates, counted once a tree and as a share of a block's rows, that reach the recall on the sample."""
    if len(sample) <= k + 1:
        return float(TREES)
    forest = Forest(sample)
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    places = np.arange(len(sample))
    true = [set(_nearest(distances(sample, q), places, k + 1).tolist()) for q in queries]
    share = 1 / 256
    while share < TREES:
        found = forest.candidates(queries, share * len(sample))
        if sum(len(t.intersection(f.tolist())) for t, f in zip(true, found, strict=True)) >= recall * sum(map(len, true)):
            break
        share *= 2
    return min(share, float(TREES))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, embedding as doubles: rows with an id and a vector that is not empty, zero or holding null or non-finite numbers."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(good).where(F.exists("embedding", lambda x: x != 0))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int, enough: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_id, vec_id, score: the k nearest of every block. Rows (size, block, asked, vec_id, embedding) come sorted, a block's rows before its queries."""
        key, forest = None, None
        ids, rows = [], []  # of the block that is being read

        def answered(queries: np.ndarray, query_ids: np.ndarray) -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            found = forest.candidates(queries, enough.get(vectors.shape[1], float(TREES)) * len(vectors))
            for query_id, query, near in zip(query_ids.tolist(), queries, found, strict=True):
                near = near[row_ids[near] != query_id]
                score = distances(vectors[near], query)
                best = _nearest(score, row_ids[near], k)
                for column, values in zip(out, (np.full(len(best), query_id), row_ids[near][best], score[best]), strict=True):
                    column.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

        for batch in batches:
            size, block, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fresh = (np.diff(size) != 0) | (np.diff(block) != 0) | (np.diff(asked) != 0)
            cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if (mine := (int(size[a]), int(block[a]))) != key:
                    key, forest, ids, rows = mine, None, [], []
                part_ids, part = batch.column(3)[a:z].to_numpy(), _vectors(batch.column(4)[a:z])
                if not asked[a]:
                    ids.append(part_ids)
                    rows.append(part)
                elif rows:
                    if forest is None:
                        vectors, row_ids = np.concatenate(rows), np.concatenate(ids)
                        forest = Forest(vectors)
                    yield answered(part, part_ids)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of each query, never itself.

    Only vectors that `usable` keeps take part, and only those of a query's own length are compared with it. Rows that repeat an
    id and a vector count once; a query that meets fewer than k rows gets all; empty tables give an empty result; other columns
    are not read, whatever their names.
    """
    small_batches(vectors.sparkSession)
    rows, wanted = cut(usable(vectors).distinct()), usable(queries).distinct()
    # A bounded sample, smaller than any of several blocks: the share of rows that is enough falls as a block grows.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, BLOCK_ROWS // 2)).collect()
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    enough = {size: fit_enough(np.array(held), k) for size, held in by_size.items()}
    blocks = -(-rows.count() // BLOCK_ROWS) or 1
    columns = [F.size("embedding").alias("size"), "block", "asked", "vec_id", "embedding"]
    placed = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)), "asked": F.lit(0)}).select(*columns)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = wanted.withColumn("block", every).withColumn("asked", F.lit(1)).select(*columns)
    dealt = placed.unionByName(asked).repartition("size", "block").sortWithinPartitions("size", "block", "asked")
    found = dealt.mapInArrow(_search(k, enough), "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
