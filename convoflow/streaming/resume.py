"""Incremental runs: what is done is a table, what is left an anti-join; as a stream the checkpoint keeps count."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convoflow import keys as key_columns


def _of(rows: DataFrame, completed: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """The columns that both tables tell chunks by."""
    return list(keys) if keys else [c for c in key_columns.chunk(rows) if c in completed.columns]


def _known(rows: DataFrame, completed: DataFrame, keys: Sequence[str] | None, how: str) -> DataFrame:
    by = _of(rows, completed, keys)
    return rows.join(completed.select(*key_columns.renamed(by, "_k_")).distinct(), key_columns.same(by, "_k_"), how)


def remaining(chunks: DataFrame, completed: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Chunks that are not completed, by the keys that are named or by document and chunk."""
    return _known(chunks, completed, keys, "left_anti")


def mark(completed: DataFrame, path: str) -> None:
    """Adds chunk_id lines to a marker file, those that it does not hold yet."""
    known = completed.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = known.getFileSystem(completed.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(known)
    new = completed.select("chunk_id").distinct()
    new = remaining(new, completed_ids(completed.sparkSession.read.text(path))) if there else new
    new.select(F.col("chunk_id").cast("string")).write.mode("append").text(path)


def kept_output(utterances: DataFrame, completed: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of completed chunks only: what a broken run left of others goes."""
    return _known(utterances, completed, keys, "left_semi")


def completed_ids(lines: DataFrame) -> DataFrame:
    """chunk_id from marker lines (value); lines that are no number are left out."""
    return lines.select(F.expr("try_cast(trim(value) AS BIGINT)").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()


def processed_ids(utterances: DataFrame, marker: DataFrame | None = None, doc: Sequence[str] | None = None) -> DataFrame:
    """Document columns, chunk_id: the marker's ids; without any, those of the output but each document's last one written, which may be incomplete."""
    by = key_columns.document(utterances, doc)
    if marker is not None and not marker.isEmpty():
        return marker.select(*[c for c in by if c in marker.columns], "chunk_id").distinct()
    last = utterances.groupBy(*by).agg(F.max_by("chunk_id", F.struct("line_no", "chunk_id")).alias("chunk_id"))
    return remaining(utterances.select(*by, "chunk_id").where("chunk_id IS NOT NULL").distinct(), last, [*by, "chunk_id"])


def first_missing(ids: DataFrame, doc: Sequence[str] | None = None) -> DataFrame:
    """Document columns, chunk_id: the least number from 0 that is not among ids, of each document that has any."""
    if by := key_columns.document(ids, doc):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("chunk_id")) - 1
        numbered = ids.where("chunk_id >= 0").select(*by, "chunk_id").distinct().withColumn("_place", place)
        found = ids.select(*by).distinct().join(numbered.where("_place = chunk_id").groupBy(*key_columns.renamed(by, "_k_")).agg(F.count(F.lit(1)).alias("_n")), key_columns.same(by, "_k_"), "left")
        return found.select(*by, F.coalesce("_n", F.lit(0)).cast("long").alias("chunk_id"))
    known = ids.where("chunk_id >= 0").select("chunk_id").distinct()
    following = known.select((F.col("chunk_id") + 1).alias("chunk_id")).unionByName(ids.sparkSession.range(1).select(F.col("id").alias("chunk_id")))
    return following.join(known, "chunk_id", "left_anti").agg(F.min("chunk_id").alias("chunk_id"))


def finish(extracted: DataFrame) -> DataFrame:
    """The good rows; an error if any chunk failed, after they can be written."""
    return extracted.where("status = 'ok'")


def assert_complete(extracted: DataFrame) -> None:
    n = extracted.where("status = 'failed'").count()
    if n:
        raise RuntimeError(f"{n} chunks failed")


def run_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Takes in what is new under source, transforms it and appends it to sink, then ends; a later call goes on from there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
