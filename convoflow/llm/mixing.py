"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. From that histogram alone a plan says how many documents of each
length a source gives: a proportional share of every length first, then a bounded-knapsack dynamic program over the counts
that are left, which closes the remaining budget. Which documents of a length go in is decided by a seeded hash, so reruns
agree and every length keeps a random sample of its documents.

Only the histogram (distinct lengths of a source) is ever gathered; documents are ranked within hash buckets of about
RANK_BUCKET rows, equal rows as one with their number, so neither a hot source nor a length nor a row that a third of all
documents share meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, lookup

#: Words of a source's budget that are left to the dynamic program.
DP_WINDOW = 8192
RANK_BUCKET = 2048


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float, weights: Sequence[int], repeats: int) -> DataFrame:
    """(source, source_size) -> plus source_no and target: budget times all sizes, shared by weight and stopped at repeats times a source's size.

    One row per source: the windows below sort that small table only.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    # Sources whose cap is reached first come first; the level is that of the first source that stays below its cap.
    by_ratio = Window.orderBy("_ratio", "source_no")
    ranked = ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("_w_left", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_w_left"))
    open_level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_no", "_level"))).over(everything)
    level = open_level["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return ranked.select("source", "source_no", "source_size", target.cast("double").alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: float, window: int = DP_WINDOW) -> np.ndarray:
    """How many of counts[i] items of sizes[i] to take, so that their sum comes as near to budget as can be.

    Proportional shares of each size fill all but `window` of the budget; the rest is a bounded knapsack over what is left,
    solved with a bit set of reachable sums, each count split into powers of two. Sizes are positive and distinct.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    order = np.argsort(-sizes)
    share, due, got = max(0.0, budget - window) / total, 0.0, 0
    for i in order:
        size, count = int(sizes[i]), int(counts[i])
        due += share * size * count
        take[i] = min(count, max(0, int((due - got) // size)))
        got += size * int(take[i])
    rest = budget - got
    goal = int(rest + 0.5)
    mask = (1 << (2 * goal + 2)) - 1
    sums, steps = 1, []  # bit s: a sum of s can be reached
    for i in order[::-1]:
        size, left, unit = int(sizes[i]), int(counts[i] - take[i]), 1
        left = min(left, (2 * goal + 1) // size)
        while left > 0 and not sums >> goal & 1:
            unit = min(unit, left)
            steps.append((i, unit, sums))
            sums |= sums << unit * size & mask
            left, unit = left - unit, unit * 2
    below = sums & ((1 << (goal + 1)) - 1)
    low = below.bit_length() - 1
    above = sums >> (goal + 1)
    high = goal + 1 + ((above & -above).bit_length() - 1) if above else None
    at = low if high is None or abs(rest - low) <= high - rest else high
    for i, unit, before in reversed(steps):
        if not before >> at & 1:
            take[i] += unit
            at -= unit * int(sizes[i])
    return take


def _plan(window: int):
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        total, target = int((sizes * counts).sum()), float(rows["target"].iloc[0])
        whole = int(target // total) if total else 0
        some = sizes > 0
        extra = np.zeros(len(sizes), dtype=np.int64)
        extra[some] = fit_counts(sizes[some], counts[some], target - whole * total, window)
        return pd.DataFrame({"source_no": rows["source_no"], "size": sizes, "n": counts, "whole": whole, "extra": extra})

    return plan


def ranked(docs: DataFrame, budget: float, weights: Sequence[int], repeats: int, seed: int, window: int) -> DataFrame:
    """docs (doc_id, source, size, tie) -> each distinct row once: plus rows (how many there are), source_size, target, whole, _hash, and extra: how many of them are taken once more."""
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")
    rows = cut(docs.select("doc_id", "source", size, "tie").groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows")))
    histogram = rows.groupBy("source", "size").agg(F.sum("rows").alias("n"))
    targets = cut(source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), budget, weights, repeats))
    by_source = lookup(histogram, targets, ["source"], ["size"], "inner").select("source_no", "size", "n", "target")
    plan = cut(by_source.groupBy("source_no").applyInPandas(_plan(window), "source_no long, size long, n long, whole long, extra long").withColumnRenamed("extra", "_stratum"))
    placed = lookup(lookup(rows, targets, ["source"], ["doc_id", "tie"], "inner"), plan, ["source_no", "size"], ["doc_id", "tie"], "inner")
    unit = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    placed = placed.withColumn("_hash", _hash(seed)).withColumn("_bucket", F.floor(unit * F.ceil(F.col("n") / RANK_BUCKET)))
    key = ["source_no", "size", "_bucket"]
    # Only lengths of more than one bucket need to know what the buckets before theirs hold.
    before = Window.partitionBy("source_no", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.where(F.col("n") > RANK_BUCKET).groupBy(*key).agg(F.sum("rows").alias("_held"))
    held = held.select(*key, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    upto = F.sum("rows").over(Window.partitionBy(*key).orderBy(_order(F.col("_hash")), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = placed.withColumn("_upto", upto).join(held, key, "left")
    left = F.col("_stratum") - F.coalesce(F.col("_before"), F.lit(0)) - F.col("_upto") + F.col("rows")
    return found.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("rows"), left)))


def _hash(seed: int) -> F.Column:
    return F.xxhash64(F.col("doc_id"), F.col("tie"), F.lit(seed))


def _order(hashed: F.Column) -> F.Column:
    """Hashes in the order of the buckets: as unsigned numbers."""
    return hashed.bitwiseXOR(F.lit(-(1 << 63)))


def mix(docs: DataFrame, budget: float = 1.5, weights: Sequence[int] = (5, 2, 1), repeats: int = 2, seed: int = 17, window: int = DP_WINDOW) -> DataFrame:
    """docs with doc_id, source, size and tie -> doc_id, source, size, source_size, target, copies: one row per row of docs.

    copies is how often the mix takes a document, at most `repeats`. tie (a number, such as a hash of the text) tells rows of
    one id apart. Documents without words are never taken; a null source is a source of its own, last in order; null ids are
    ranked like any other value; rows that are wholly equal are counted first, and as many of them are taken once more as the
    plan says; an empty table gives an empty result. Other columns are not read.
    """
    found = ranked(docs, budget, weights, repeats, seed, window)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")
    each = found.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", copy)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + (F.col("copy") <= F.col("extra")).cast("int"))
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def row_hash(docs: DataFrame) -> F.Column:
    """A tie for `mix` that tells all rows apart but those that are wholly equal."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, size: F.Column, budget: float = 1.5, weights: Sequence[int] = (5, 2, 1), repeats: int = 2, seed: int = 17, window: int = DP_WINDOW) -> DataFrame:
    """docs with every row as often as `mix` takes it, tied by `row_hash`: all its columns, however many and whatever their names.

    A stratum (source and length) keeps the last place in the order that it takes once more, so whole rows meet only that small
    table. Only where that place has more equal rows than are taken, they are gathered as one row with a number.
    """
    tie = row_hash(docs)
    rows = ranked(docs.select("doc_id", "source", size.alias("size"), tie.alias("tie")), budget, weights, repeats, seed, window)
    place = [_order(F.col("_hash")).alias("hash"), F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("tie").alias("tie")]
    last = F.max(F.when(F.col("extra") > 0, F.struct(*place, "extra", "rows")))
    strata = cut(rows.where("size > 0").groupBy("source", "size").agg(F.first("whole").alias("whole"), last.alias("last")))
    strata = strata.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "whole", "last")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("_source"), size.alias("_size"), F.col("doc_id"), tie.alias("tie"))
    named = named.withColumn("_hash", _hash(seed)).withColumn("mine", F.struct(*place)).select("row", "_source", "_size", "mine")
    met = lookup(named, strata, ["_source", "_size"], ["mine"], "inner")
    at = F.struct(*[F.col(f"last.{c}").alias(c) for c in ("hash", "known", "id", "tie")])
    some = F.coalesce(F.col("mine").eqNullSafe(at) & (F.col("last.extra") < F.col("last.rows")), F.lit(False))
    copies = F.col("whole") + (F.col("last").isNotNull() & (F.col("mine") <= at)).cast("int")
    whole = met.where(~some).select("row", copies.cast("long").alias("copies"))
    equal = met.where(some).groupBy("_source", "_size").agg(F.first("row").alias("row"), F.first(F.col("last.rows") * F.col("whole") + F.col("last.extra")).alias("copies"))
    return whole.unionByName(equal.select("row", "copies")).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tie"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
