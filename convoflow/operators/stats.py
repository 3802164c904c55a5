"""Statistics over utterances (document columns, chunk_id, dialogue_index, role, dialogue).

Chunks are told apart by their documents. What is counted over a whole table can be had for each document by naming its columns
(`per`); the same holds for what is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoflow import keys


def named(utterances: DataFrame) -> DataFrame:
    role = F.when(F.coalesce("role", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("role"))
    return utterances.withColumns({"role": role, "chars": F.length(F.coalesce("dialogue", F.lit(""))).cast("long")})


def _from(n: int, p: float, column: str, name: str) -> Column:
    """A quantile where there are n values, else the greatest."""
    return F.coalesce(F.when(F.count(F.lit(1)) >= n, F.percentile(column, p)).otherwise(F.max(column)), F.lit(0)).cast("double").alias(name)


def length_summary(utterances: DataFrame, tokens: Column | None = None, per: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each document: totals, average, least, quantiles and greatest length; average tokens where a count is given."""
    rows = named(utterances)
    rows = rows.withColumn("_tokens", tokens) if tokens is not None else rows
    extra = [F.avg("_tokens").alias("average_tokens")] if tokens is not None else []
    return rows.groupBy(*per).agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("role").alias("roles"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.avg("chars"), F.lit(0.0)).alias("average"),
        F.coalesce(F.min("chars"), F.lit(0)).alias("least"), F.coalesce(F.percentile("chars", 0.5), F.lit(0.0)).alias("p50"), _from(10, 0.9, "chars", "p90"), _from(100, 0.99, "chars", "p99"), F.coalesce(F.max("chars"), F.lit(0)).alias("most"), *extra,
    )


def role_stats(utterances: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """role, n, chars, average."""
    return named(utterances).groupBy(*per, "role").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.avg("chars").alias("average"))


def top_roles(utterances: DataFrame, k: int = 10, per: Sequence[str] = ()) -> DataFrame:
    """role, n of the k roles that speak most, of the whole table or of each document; ties by where they are first seen."""
    first = F.min(F.struct(*keys.document(utterances), "chunk_id", "dialogue_index"))
    found = named(utterances).groupBy(*per, "role").agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
    if not per:
        return found.orderBy(F.desc("n"), "_first").limit(k).drop("_first")
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("n"), "_first"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_first", "_rank")


def transitions(utterances: DataFrame, order: str = "dialogue_index", doc: Sequence[str] | None = None, per: Sequence[str] = ()) -> DataFrame:
    """from_role, to_role, n: neighbours within a chunk of one document."""
    before = F.lag("role").over(Window.partitionBy(*keys.chunk(utterances, doc)).orderBy(order))
    rows = named(utterances.where("chunk_id IS NOT NULL")).withColumn("from_role", before)
    return rows.where("from_role IS NOT NULL").groupBy(*per, "from_role", F.col("role").alias("to_role")).agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(utterances: DataFrame, doc: Sequence[str] | None = None) -> DataFrame:
    """Document columns, chunk_id, dialogues, chars, least, most, average, roles (a map to counts)."""
    by = keys.chunk(utterances, doc)
    by_role = named(utterances.where("chunk_id IS NOT NULL")).groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"), F.min("chars").alias("lo"), F.max("chars").alias("hi"))
    found = by_role.groupBy(*by).agg(F.sum("n").alias("dialogues"), F.sum("c").alias("chars"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    return found.withColumn("average", F.col("chars") / F.col("dialogues"))


def density(utterances: DataFrame, doc: Sequence[str] | None = None, per: Sequence[str] = ()) -> DataFrame:
    """One row over chunk_stats, or one for each document: how many dialogues chunks have."""
    return chunk_stats(utterances, doc).groupBy(*per).agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("dialogues"), F.lit(0)).alias("dialogues"), F.coalesce(F.min("dialogues"), F.lit(0)).alias("least"), F.coalesce(F.max("dialogues"), F.lit(0)).alias("most"),
        F.coalesce(F.avg("dialogues"), F.lit(0.0)).alias("average"), F.coalesce(F.percentile("dialogues", 0.5), F.lit(0.0)).alias("p50"), _from(10, 0.9, "dialogues", "p90"),
    )


def densest(utterances: DataFrame, k: int = 5, doc: Sequence[str] | None = None) -> DataFrame:
    """The chunks with most dialogues; ties by their key."""
    by = keys.chunk(utterances, doc)
    return utterances.where("chunk_id IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("dialogues")).orderBy(F.desc("dialogues"), *by).limit(k)


def invalid_lines(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("v").isNull()).alias("invalid_lines"))


def ordered(utterances: DataFrame, doc: Sequence[str] | None = None) -> DataFrame:
    """Sorted by document and key; an utterance without a chunk or a number is an error."""
    missing = utterances.where("chunk_id IS NULL OR dialogue_index IS NULL")
    if not missing.isEmpty():
        raise ValueError("an utterance has no chunk_id or dialogue_index")
    return utterances.orderBy(*keys.utterance(utterances, doc), *(["line_no"] if "line_no" in utterances.columns else []))


def of_chunks(utterances: DataFrame, chunk_ids: list[int]) -> DataFrame:
    """Those of the given chunks; an utterance without a chunk is an error."""
    known = F.when(F.col("chunk_id").isNull(), F.raise_error(F.lit("an utterance has no chunk_id"))).otherwise(F.col("chunk_id"))
    return utterances.where(known.isin(*chunk_ids))


def head(rows: DataFrame, n: int = 8, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)
