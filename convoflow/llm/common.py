"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: what a word is, as a Java/Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that part words.
SPACES = " \t\n\r\x0b\x0c"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch. Texts run from nothing to megabytes, so a number of rows alone bounds no memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Has this session hand Python workers batches of BATCH_BYTES (or of one row), unless its user has set a bound."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the context was given.

    Where neither is set, a run on one machine (a local master, as in tests) gets a temporary one; on a cluster such a folder
    would lose or split what executors write, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='convoflow-')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder, so that what follows neither recomputes it nor depends on one executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows reads only the columns that it needs. Any column names will do."""
    folder = new_folder(df.sparkSession, name)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(folder)
    return df.sparkSession.read.parquet(folder).toDF(*df.columns)


#: Rows of a measured lookup table that every executor may be sent; all of them are a few dozen bytes wide.
BROADCAST_ROWS = 200_000
#: A key that more than this share of all rows have is hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 256


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], spread: list[str], how: str = "left", wide: bool = False) -> DataFrame:
    """rows joined with a table that has each of its keys once; null keys match each other. Columns named _hot and _salt are used.

    The table is counted: up to BROADCAST_ROWS rows are broadcast, unless they are wide. Any other is joined by key, and keys that very many rows
    share are spread over salts by the `spread` columns, so that no task meets them all.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    other = found.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in found.columns if c not in keys])
    same = [rows[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    if not wide and found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), same, how).drop(*names)
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = rows.count() // HOT_KEYS
    hot = cut(counts.where(F.col("_n") > least).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot")))
    marks = [f"_h{i}" for i in range(len(keys))]
    left = rows.join(F.broadcast(hot), [rows[k].eqNullSafe(F.col(m)) for k, m in zip(keys, marks, strict=True)], "left").drop(*marks)
    left = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    right = other.join(F.broadcast(hot), [F.col(n).eqNullSafe(F.col(m)) for n, m in zip(names, marks, strict=True)], "left").drop(*marks)
    spread_out = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = right.withColumn("_other", F.explode(spread_out)).drop("_hot")
    return left.join(right, [*[left[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col("_salt") == F.col("_other")], how).drop(*names, "_salt", "_other")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() parts exactly at 0x20 and 0x09-0x0D; multi-byte characters hold none of them."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_runs(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """A batch's texts in runs of about `chars` bytes (or one text), so that only a run at a time is made into Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)))
        yield texts[at:upto].to_pylist()
        at = upto


def tidy() -> None:
    """Hands memory that a batch has freed back to the system: Python workers live on, beside executors that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
