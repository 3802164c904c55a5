"""JSON-lines sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoflow.functions.text import pair_file_name
from convoflow.operators.stats import of_chunks, ordered


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", order: list[str] | None = None) -> None:
    """Rows as JSON lines, sorted over all files if an order is given; null fields are left out."""
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path, ignoreNullFields=True)


def write_pairs(pairs: DataFrame, folder: str | None = None, merged: str | None = None, mode: str = "overwrite") -> None:
    """Pair samples into one folder for each direction, or all together: one of the two. Names that two directions would share get a hash.

    Merged samples are sorted by direction, directions by where they are first seen, and by place within one.
    """
    if (folder is None) == (merged is None):
        raise ValueError("give either folder or merged")
    place = F.struct("reply.chunk_id", "reply.dialogue_index", "source.chunk_id", "source.dialogue_index")
    ends = pairs.groupBy(F.col("pair.from").alias("f"), F.col("pair.to").alias("t")).agg(F.min(place).alias("first"))
    same = (F.col("pair.from") == F.col("f")) & (F.col("pair.to") == F.col("t"))
    if merged is not None:
        ordered = pairs.join(ends, same).orderBy("first", "f", "t", place).select(*pairs.columns)
        write_json_lines(ordered, merged, mode)
        return
    names = ends.select("f", "t").withColumn("name", pair_file_name(F.col("f"), F.col("t")))
    shared = names.groupBy("name").count().where("count > 1").select("name").withColumn("shared", F.lit(True))
    names = names.join(shared, "name", "left").select("f", "t", F.when(F.col("shared"), F.concat_ws("-", "name", F.hex(F.xxhash64("f", "t")))).otherwise(F.col("name")).alias("pair_name"))
    pairs.join(names, same).drop("f", "t").write.mode(mode).partitionBy("pair_name").json(folder, ignoreNullFields=True)


def write_copy(utterances: DataFrame, path: str, chunk_ids: list[int] | None = None, mode: str = "errorifexists") -> None:
    """A copy of utterances (file, line_no and v may be there) sorted by key, or of the given chunks only, in the order of their lines."""
    rows = ordered(utterances) if chunk_ids is None else of_chunks(utterances, chunk_ids).orderBy("line_no")
    write_json_lines(rows.drop("file", "line_no", "v"), path, mode)
