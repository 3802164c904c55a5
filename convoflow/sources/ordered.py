"""An ordered table of parts: what is written in order is read in order, without sorting it again.

An append deals its rows out by ranges of the order and sorts each, so its files follow one another; a manifest says for each file
how many rows come before it and which keys it begins and ends with. Appends follow one another as they were made. A part without
its manifest line is what a broken append left, and is not read. Readers take files as the manifest lists them, or only those that
a stretch of rows or of keys can lie in.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The manifest's own columns; low and high are the order's columns as JSON.
MANIFEST = "append long, part string, file string, rows long, before long, low string, high string"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order: append, part, file, rows, before (rows of the table that come first), low, high."""
    system, path = _path(spark, f"{folder}/manifest")
    if not system.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest").orderBy("append", "before")


def append(rows: DataFrame, folder: str, order: list[str], rows_a_file: int = 1_000_000) -> int:
    """Adds rows behind those that are there, sorted by `order` (nulls first; ties as they come); returns how many. No rows add nothing.

    Sorting deals rows over tasks by ranges; only counts and bounds of files go through the driver's manifest line, one a file.
    """
    spark = rows.sparkSession
    last = manifest(spark, folder).agg(F.max("append").alias("append"), F.sum("rows").alias("rows")).first()
    number, before, part = (last["append"] if last["append"] is not None else -1) + 1, last["rows"] or 0, uuid.uuid4().hex
    rows.orderBy(*order).write.option("maxRecordsPerFile", rows_a_file).parquet(f"{folder}/parts/{part}")
    key = F.to_json(F.struct(*order), {"ignoreNullFields": "false"})
    place = F.struct(*order)
    files = spark.read.parquet(f"{folder}/parts/{part}").groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    found = files.agg(F.count(F.lit(1)).alias("rows"), F.min_by(key, place).alias("low"), F.max_by(key, place).alias("high"))
    # Names of files ascend with their ranges, and within a task with the files it has begun.
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    lines = found.select(F.lit(number).cast("long").alias("append"), F.lit(part).alias("part"), "file", "rows", (F.coalesce(F.sum("rows").over(upto), F.lit(0)) + before).alias("before"), "low", "high")
    lines.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    total = manifest(spark, folder).where(F.col("append") == number).agg(F.sum("rows")).first()[0]
    return total or 0


def _files(spark: SparkSession, folder: str, found: list) -> DataFrame | None:
    """The files one after the other: a union keeps the order of its sides, and a file's splits follow one another."""
    sides = [spark.read.parquet(f"{folder}/parts/{r['part']}/{r['file']}") for r in found]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides) if sides else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows in the order of the table. Its rows, collected or written as they come, need no sort."""
    found = _files(spark, folder, manifest(spark, folder).collect())
    if found is None:
        raise ValueError(f"no rows at {folder}")
    return found


def stretch(spark: SparkSession, folder: str, first: int, n: int) -> DataFrame:
    """Rows first to first + n - 1 of the table, in order: only the files that they lie in are read."""
    lines = manifest(spark, folder).where((F.col("before") < first + n) & (F.col("before") + F.col("rows") > first)).collect()
    found = _files(spark, folder, lines)
    if found is None:
        raise ValueError(f"no rows from {first} on at {folder}")
    return found.offset(max(0, first - lines[0]["before"])).limit(n)


def is_sorted(spark: SparkSession, folder: str, order: list[str]) -> bool:
    """Whether the appends, one behind the other, are in the order of the keys throughout, as the manifest's bounds say."""
    lines = manifest(spark, folder)
    if not lines.head(1):
        return True
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read(spark, folder).select(*order).schema)
    high = F.from_json("high", kinds)
    behind = F.lag(high).over(Window.orderBy("before"))
    return lines.select((behind > F.from_json("low", kinds)).alias("broken")).where("broken").isEmpty()
