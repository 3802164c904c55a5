"""The operators from Spark SQL: table functions and views.

    register(spark)
    spark.sql("SELECT * FROM segment_lines(TABLE(lines) PARTITION BY (doc_id) ORDER BY (line_no), 1000, 100)")

Both functions see one partition's rows in order and hold no more than they must: the lines of one chunk and its overlap, or the
samples of one bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from convoflow.functions.text import SENTENCE_END
from convoflow.operators import chat, segment
from convoflow.sources.jsonl import as_lines

_ENDS = re.compile(SENTENCE_END)


class SegmentLines:
    """TABLE (doc_id, line_no, line), limit and cover in characters -> doc_id, chunk_id, chunk_text. A partition is a document."""

    def __init__(self) -> None:
        self.doc, self.chunk_id = None, 0
        #: Lines of the open chunk, and of those before it that an overlap may still need.
        self.held: list[str] = []
        self.recent: list[str] = []
        self.used = 0

    def _chunk(self, text: str) -> tuple:
        self.chunk_id += 1
        return self.doc, self.chunk_id - 1, text

    def eval(self, row: Row, limit: int, cover: int) -> Iterator[tuple]:
        self.doc, line, size = row["doc_id"], row["line"], len(row["line"])
        if size > limit:
            if self.held:
                yield self._chunk("\n".join(self.held))
            for part in segment._packed([p for p in _ENDS.split(line) if p], len, limit):
                yield self._chunk(part)
            self.held, self.used, self.recent = [], 0, []
            return
        if self.held and self.used + size + 1 > limit:
            yield self._chunk("\n".join(self.held))
            self.held, self.used = [], 0
            for before in reversed(self.recent):
                if self.used >= cover or self.used + len(before) > cover:
                    break
                self.held.insert(0, before)
                self.used += len(before)
            if self.used + size + 1 > limit:
                self.held, self.used = [], 0
        self.held.append(line)
        self.used += size + 1
        self.recent.append(line)
        while len(self.recent) > 1 and sum(map(len, self.recent[1:])) >= cover:
            self.recent.pop(0)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._chunk("\n".join(self.held))


class StitchSamples:
    """TABLE (chunk_id, role_a, role_b, s, r, r_chunk, s_role, r_role), most turns -> bucket, session, place, s, r. A partition is a bucket, in the order of its samples."""

    def __init__(self) -> None:
        self.edges: list[dict] = []
        self.bucket, self.turns = None, 1

    def eval(self, row: Row, turns: int) -> Iterator[tuple]:
        self.bucket, self.turns = (row["chunk_id"], row["role_a"], row["role_b"]), turns
        self.edges.append({k: row[k] for k in ("s", "r", "r_chunk", "s_role", "r_role")})
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        for session, places in enumerate(chat._chained(self.edges, self.bucket[0], self.turns)):
            for place, at in enumerate(places):
                yield *self.bucket, session, place, self.edges[at]["s"], self.edges[at]["r"]


def register(spark: SparkSession) -> None:
    """The table functions segment_lines and stitch_samples, for this session's SQL."""
    spark.udtf.register("segment_lines", udtf(SegmentLines, returnType="doc_id long, chunk_id long, chunk_text string"))
    spark.udtf.register("stitch_samples", udtf(StitchSamples, returnType="chunk_id long, role_a string, role_b string, session long, place long, s long, r long"))


def views(docs: DataFrame | None = None, utterances: DataFrame | None = None, prefix: str = "convoflow_") -> list[str]:
    """Temporary views: documents and their clean lines; utterances and the raw lines that they are. Returns their names."""
    found = {}
    if docs is not None:
        found |= {"documents": docs, "lines": segment.clean_lines(docs)}
    if utterances is not None:
        found |= {"utterances": utterances, "raw_lines": as_lines(utterances)}
    for name, rows in found.items():
        rows.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in found]
