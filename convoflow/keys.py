"""What tells rows apart: document columns lead every key, so that documents may number their chunks alike.

Operators take the names of a table's document columns, or find `doc_id` where a table has it. A table without such columns is
one document. Document columns may be null: a null is a document like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = ("doc_id",)


def document(rows: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    """The document columns: those that are named, or the usual ones that the table has."""
    if keys is None:
        return [c for c in DOCUMENT if c in rows.columns]
    if missing := [c for c in keys if c not in rows.columns]:
        raise ValueError(f"no column {', '.join(missing)} to tell documents apart by")
    return list(keys)


def chunk(rows: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    return [*document(rows, keys), "chunk_id"]


def utterance(rows: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    return [*chunk(rows, keys), "dialogue_index"]


def renamed(names: Sequence[str], prefix: str) -> list[Column]:
    """The columns under other names, for the other side of a join."""
    return [F.col(c).alias(f"{prefix}{c}") for c in names]


def same(names: Sequence[str], prefix: str) -> Column:
    """Whether the columns agree with those that `renamed` has made; nulls agree with nulls."""
    found = F.lit(True)
    for c in names:
        found = found & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return found


def latest(rows: DataFrame) -> list[Column]:
    """An order in which the last row counts: by line where lines are numbered, then by content, so that it never depends on tasks."""
    line = [F.col("line_no").desc()] if "line_no" in rows.columns else []
    return [*line, *(F.col(c).desc_nulls_last() for c in ("dialogue", "role") if c in rows.columns)]
