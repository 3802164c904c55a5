"""The folder that driver and executors share, tables cut from their lineage there, and texts handed to Python a little at a time."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: texts run from nothing to megabytes, so a number of rows alone bounds no memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has this session hand Python workers batches of BATCH_BYTES (or of one row), unless its user has set a bound."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def text_runs(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """A batch's texts in runs of about `size` characters (or one text), so that what is made of a run can go before the next."""
    run: list[str | None] = []
    held = 0
    for text in texts:
        run.append(text.as_py())
        held += len(run[-1] or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def tidy() -> None:
    """Hands memory that a batch has freed back to the system: Python workers live on, beside executors that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the context was given; a temporary one only for a local master."""
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


def cut(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder, so that loops over it neither recompute it nor depend on one executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
