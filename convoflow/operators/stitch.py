"""Stitching by pointer doubling, for talk that is too long to be gathered in one row.

Where every utterance of a bucket answers one other that comes before it, samples are the edges of a forest: the greedy fold goes
from an edge to the first one that its reply is the source of, and starts anew where an edge is no first one. So a session is a
path of such first edges, cut at its length, and the place of an edge on its path is found by doubling: in round k every edge
knows what lies 2^k edges before it. A bucket that is no such forest (a repeated sample, a reply before its source) keeps the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoflow import keys
from convoflow.shared import cut


def numbered(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Samples as edges: bucket columns, n (place in the bucket's order), s, r and roles of their ends, row, and forest: whether the bucket is one."""
    key = [F.col(c) for c in by] + [F.col("source.chunk_id").alias("chunk_id"), F.least("pair.from", "pair.to").alias("role_a"), F.greatest("pair.from", "pair.to").alias("role_b")]
    edges = pairs.select(
        *key, F.col("source.dialogue_index").alias("s"), F.col("reply.dialogue_index").alias("r"), F.col("reply.chunk_id").alias("r_chunk"),
        F.col("source.role").alias("s_role"), F.col("reply.role").alias("r_role"), F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("row"),
    )
    bucket = [*by, "chunk_id", "role_a", "role_b"]
    within = F.col("r_chunk").eqNullSafe(F.col("chunk_id"))
    copies = F.count(F.when(within, F.lit(1))).over(Window.partitionBy(*bucket, "r_role", "r"))
    odd = F.coalesce(within & ((copies > 1) | (F.col("s") >= F.col("r"))), F.lit(True))
    whole = Window.partitionBy(*bucket)
    order = whole.orderBy("s", "r", "r_chunk", "s_role", "r_role", "row")
    rows = edges.withColumn("_odd", odd)
    return rows.withColumns({"n": F.row_number().over(order).cast("long"), "forest": ~F.max("_odd").over(whole)}).drop("_odd")


def placed(edges: DataFrame, by: list[str], max_turns: int) -> DataFrame:
    """Edges of forests (as `numbered` makes them) plus session, from 0 in a bucket, and place in it."""
    bucket = [*by, "chunk_id", "role_a", "role_b"]
    same = keys.same(bucket, "_u_")
    first = F.row_number().over(Window.partitionBy(*bucket, "s_role", "s").orderBy("n")) == 1
    narrow = cut(edges.select(*bucket, "n", "s", "r", "s_role", "r_role", F.col("r_chunk").eqNullSafe(F.col("chunk_id")).alias("within"), first.alias("first")))
    above = narrow.where("within").select(*keys.renamed(bucket, "_u_"), F.col("r").alias("_r"), F.col("r_role").alias("_role"), F.col("n").alias("up"))
    joined = narrow.join(above, same & F.col("first") & (F.col("s") == F.col("_r")) & (F.col("s_role") == F.col("_role")), "left")
    # up: an edge before this one on its path, and how far before; an edge that begins a path is its own.
    now = cut(joined.select(*bucket, "n", F.coalesce("up", "n").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far")))
    while True:
        other = now.where("far > 0").select(*keys.renamed(bucket, "_u_"), F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        now = now.join(other, same & (F.col("up") == F.col("_n")), "left")
        now = cut(now.select(*bucket, "n", F.coalesce("_up", "up").alias("up"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_n").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
    path = now.select(*bucket, "n", F.col("up").alias("head"), F.floor(F.col("far") / max(1, max_turns)).alias("part"), (F.col("far") % max(1, max_turns)).alias("place"))
    seed = F.min("n").over(Window.partitionBy(*bucket, "head", "part"))
    path = path.withColumn("_seed", seed).withColumn("session", (F.dense_rank().over(Window.partitionBy(*bucket).orderBy("_seed")) - 1).cast("long"))
    path = path.select(*keys.renamed(bucket, "_u_"), F.col("n").alias("_n"), "session", "place")
    return edges.join(path, same & (F.col("n") == F.col("_n"))).select(*bucket, "session", "place", "row")
