"""JSON-lines and text sources. Rows keep file and line number: order matters to several operators."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoflow.functions.text import strip


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole UTF-8 text files: doc_id (their place in the order of paths), path, text. The list of files gives the numbers, so every file is read once."""
    rows = spark.read.text(path, wholetext=True)
    alike = lambda name: re.sub(r"^(\w+):/+", r"\1:/", name)  # noqa: E731  a list of files and a row's file may write the root differently
    names = spark.createDataFrame([(i, name) for i, name in enumerate(sorted({alike(f) for f in rows.inputFiles()}))], "doc_id long, _file string")
    read = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return read.join(names, F.regexp_replace("path", r"^(\w+):/+", "$1:/") == F.col("_file")).select("doc_id", "path", "text")


def discover(spark: SparkSession, inputs: list[str], recursive: bool = False) -> list[str]:
    """The files that inputs stand for, each once and sorted: a folder for its `.jsonl` files (and the `.json` ones
    that Spark writes), a pattern for the `.jsonl` files that match, and any other path for itself. What is not there is warned of."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for name in inputs:
        path = hadoop.Path(name)
        system = path.getFileSystem(configuration)
        many = any(c in name for c in "*?[]")
        held: list[str] = []
        for status in (system.globStatus(path) if many else [system.getFileStatus(path)] if system.exists(path) else None) or []:
            if status.isFile() and (not many or str(status.getPath()).lower().endswith(".jsonl")):
                held.append(str(status.getPath()))
            elif status.isDirectory() and not many:
                inside = system.listFiles(status.getPath(), recursive)
                while inside.hasNext():
                    child = inside.next().getPath()
                    if child.getName().lower().endswith((".jsonl", ".json")) and not child.getName().startswith(("_", ".")):
                        held.append(str(child))
        if not held:
            warnings.warn(f"no input at {name}", stacklevel=2)
        found.update(held)
    return sorted(found)


def json_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """file, line_no (from 1), value, v (a variant, null where the line is no JSON); blank lines are left out.

    Duplicate keys: the last wins, unless the session says otherwise (spark.sql.variant.allowDuplicateKeys is set if it is not).
    Spark splits large files; a line's number is its place in its split and the lines of the splits before, of which only the
    counts are gathered.
    """
    if "spark.sql.variant.allowDuplicateKeys" not in spark.conf.getAll:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("file").alias("_file"), F.col("_block").alias("_start"), "_first", before.alias("_before"))
    numbered = rows.where(strip("value") != "").join(splits, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")))
    return numbered.select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value").withColumn("v", F.try_parse_json("value"))


def strict(rows: DataFrame) -> DataFrame:
    """The rows; one that is no JSON object is an error that names its file and line."""
    where = F.concat(F.lit("no JSON object: "), F.col("file"), F.lit(":"), F.col("line_no").cast("string"))
    return rows.withColumn("v", F.when(is_object(F.col("v")), F.col("v")).otherwise(F.raise_error(where).cast("variant")))


def kind(v: Column) -> Column:
    """The variant's type name: BIGINT, DOUBLE, STRING, BOOLEAN, VOID, OBJECT..., ARRAY..., DECIMAL...; null if there is none."""
    return F.schema_of_variant(v)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def rejects(rows: DataFrame) -> DataFrame:
    """Lines that are no JSON object, with the reason."""
    reason = F.when(F.col("v").isNull(), F.lit("E_JSON")).otherwise(F.lit("E_NOT_OBJECT"))
    return rows.where(F.col("v").isNull() | ~is_object(F.col("v"))).select("file", "line_no", "value", reason.alias("reason"))


def utterances(rows: DataFrame) -> DataFrame:
    """Coerced reading of utterance lines: rows without usable keys are left out; `text` stands in for a missing dialogue."""
    v = F.col("v")
    get = lambda path, type_: F.try_variant_get(v, path, type_)
    reply = at(v, "$.reply")
    has_chunk = at(reply, "$.target_chunk_id").isNotNull()
    target = F.struct(
        F.try_variant_get(reply, "$.target_index", "bigint").alias("target_index"),
        F.when(has_chunk, F.try_variant_get(reply, "$.target_chunk_id", "bigint")).otherwise(get("$.chunk_id", "bigint")).alias("target_chunk_id"),
        F.try_variant_get(reply, "$.target_role", "string").alias("target_role"),
        F.try_variant_get(reply, "$.confidence", "double").alias("confidence"),
    )
    found = rows.where(is_object(v)).select(
        "file",
        "line_no",
        get("$.chunk_id", "bigint").alias("chunk_id"),
        get("$.dialogue_index", "bigint").alias("dialogue_index"),
        get("$.role", "string").alias("role"),
        F.coalesce(get("$.dialogue", "string"), get("$.text", "string"), F.lit("")).alias("dialogue"),
        F.when(is_object(reply) & F.col("v").isNotNull(), target).alias("reply"),
    )
    return found.where("chunk_id IS NOT NULL AND dialogue_index IS NOT NULL")


def as_lines(utterances: DataFrame, doc: Sequence[str] = (), attributes: Sequence[str] = ()) -> DataFrame:
    """Typed utterances as the lines that they are in a file: document columns, line_no, value, v. Null fields stand there as null.

    Where lines are not numbered, rows of a document are numbered in the order of their keys, those that repeat one by content.
    """
    fields = [c for c in ("chunk_id", "dialogue_index", "role", "dialogue", "reply", *attributes) if c in utterances.columns]
    order = Window.partitionBy(*doc).orderBy("chunk_id", "dialogue_index", "role", "dialogue")
    rows = utterances if "line_no" in utterances.columns else utterances.withColumn("line_no", F.row_number().over(order).cast("long"))
    found = rows.select(*doc, "line_no", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    return found.withColumn("v", F.try_parse_json("value"))


def pairs(rows: DataFrame) -> DataFrame:
    """Coerced reading of pair lines; rows without both sides are left out, and pair names default to the sides' roles."""
    v = F.col("v")

    def side(name: str) -> Column:
        part = at(v, f"$.{name}")
        return F.struct(
            F.try_variant_get(part, "$.chunk_id", "bigint").alias("chunk_id"),
            F.try_variant_get(part, "$.dialogue_index", "bigint").alias("dialogue_index"),
            F.try_variant_get(part, "$.role", "string").alias("role"),
            F.try_variant_get(part, "$.text", "string").alias("text"),
        )

    found = rows.where(is_object(v) & is_object(at(v, "$.source")) & is_object(at(v, "$.reply"))).select("file", "line_no", side("source").alias("source"), side("reply").alias("reply"), "v")
    pair = F.struct(F.coalesce(F.try_variant_get("v", "$.pair.from", "string"), F.col("source.role")).alias("from"), F.coalesce(F.try_variant_get("v", "$.pair.to", "string"), F.col("reply.role")).alias("to"))
    return found.select("file", "line_no", "source", "reply", pair.alias("pair"), F.try_variant_get("v", "$.confidence", "double").alias("confidence"))
