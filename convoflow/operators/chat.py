"""Pair samples into chat records, one turn each or stitched along reply links."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoflow import keys
from convoflow.functions.text import strip, template
from convoflow.operators import stitch
from convoflow.shared import cut
from convoflow.sources import jsonl, sinks

#: Fixed value: the system message where none is given.
DEFAULT_SYSTEM = "生成对输入内容的回复。"
#: Samples of a bucket up to which it is gathered in one row and folded; the sessions of a longer one are found by links.
BUCKET_ROWS = 10_000


def usable(pairs: DataFrame, min_confidence: float | None = None, dedupe: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Samples with text on both sides and enough confidence; of equal texts, in whatever documents, the first, in `order` or by place."""
    rows = pairs.where((strip("source.text") != "") & (strip("reply.text") != ""))
    if min_confidence is not None:
        rows = rows.where(F.coalesce((F.col("confidence") >= min_confidence) & ~F.isnan("confidence"), F.lit(False)))
    if dedupe:
        by = order or (*keys.document(pairs), "source.chunk_id", "source.dialogue_index", "reply.dialogue_index")
        turn = F.row_number().over(Window.partitionBy(strip("source.text"), strip("reply.text")).orderBy(*by))
        rows = rows.withColumn("_n", turn).where("_n = 1").drop("_n")
    return rows


def _system(text: str | None, template_text: str | None, of: str = "") -> Column | None:
    if template_text:
        names = {"from_role": f"{of}pair.from", "to_role": f"{of}pair.to", "src_role": f"{of}source.role", "tgt_role": f"{of}reply.role"}
        return template(template_text, {k: F.col(c) for k, c in names.items()})
    return F.lit(text or DEFAULT_SYSTEM)


def _message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def single_turn(pairs: DataFrame, reverse: bool = False, system_text: str | None = None, system_template: str | None = None, meta: bool = False, doc: Sequence[str] | None = None) -> DataFrame:
    """One record for each sample, with its document columns: system, user, assistant."""
    by = keys.document(pairs, doc)
    user, assistant = ("reply.text", "source.text") if reverse else ("source.text", "reply.text")
    head = _system(system_text, system_template)
    body = F.array(_message("user", strip(user)), _message("assistant", strip(assistant)))
    messages = F.concat(F.array(_message("system", head)), body) if head is not None else body
    extra = [F.struct(*by, "pair", "source", "reply", "confidence").alias("meta")] if meta else []
    return pairs.select(*by, messages.alias("messages"), *extra)


def _chained(edges: list[dict], chunk: int, max_turns: int) -> list[list[int]]:
    """Places of each session's edges: chains that go on from the side that answered, nearest first. Edges come in order."""
    waiting: dict[tuple, list[int]] = {}
    for i in reversed(range(len(edges))):
        waiting.setdefault((edges[i]["s_role"], edges[i]["s"]), []).append(i)
    used, out = [False] * len(edges), []
    for seed in range(len(edges)):
        if used[seed]:
            continue
        at, held = seed, []
        while at is not None:
            used[at] = True
            held.append(at)
            edge = edges[at]
            open_ = waiting.get((edge["r_role"], edge["r"]), []) if len(held) < max_turns and edge["r_chunk"] == chunk else []
            while open_ and used[open_[-1]]:
                open_.pop()
            at = open_.pop() if open_ else None
        out.append(held)
    return out


def _buckets(pairs: DataFrame, max_turns: int, by: list[str]) -> DataFrame:
    """Document columns, chunk_id, role_a, role_b, edges (sorted, each with its whole row), session and places (into edges): one row a session.

    A bucket is the talk of two roles within one chunk of a document, so it is as small as a chunk. It is gathered once; only its
    narrow edges go to Python.
    """
    key = {**{c: F.col(c) for c in by}, "chunk_id": F.col("source.chunk_id"), "role_a": F.least("pair.from", "pair.to"), "role_b": F.greatest("pair.from", "pair.to")}
    edge = F.struct(
        F.col("source.dialogue_index").alias("s"), F.col("reply.dialogue_index").alias("r"), F.col("reply.chunk_id").alias("r_chunk"),
        F.col("source.role").alias("s_role"), F.col("reply.role").alias("r_role"), F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("row"),
    )
    held = pairs.groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    def chains(edges: pa.Array, chunks: pa.Array) -> pa.Array:
        return pa.array([_chained(e, c, max_turns) for e, c in zip(edges.to_pylist(), chunks.to_pylist(), strict=True)], pa.list_(pa.list_(pa.int32())))

    narrow = F.transform("edges", lambda e: F.struct(e["s"].alias("s"), e["r"].alias("r"), e["r_chunk"].alias("r_chunk"), e["s_role"].alias("s_role"), e["r_role"].alias("r_role")))
    found = held.withColumn("_chains", F.arrow_udf(chains, "array<array<int>>")(narrow, "chunk_id"))
    return found.select(*key, "edges", F.posexplode("_chains").alias("session", "places")).withColumn("session", F.col("session").cast("long"))


def _is_long(pairs: DataFrame, by: list[str], limit: int) -> bool:
    key = [F.col(c) for c in by] + [F.col("source.chunk_id"), F.least("pair.from", "pair.to"), F.greatest("pair.from", "pair.to")]
    return not pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).isEmpty()


def sessions(pairs: DataFrame, max_turns: int = 1, doc: Sequence[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Samples plus bucket columns (chunk_id, role_a, role_b), session (from 0 in a bucket, by first sample) and place in it.

    Where a bucket has more than bucket_rows samples, buckets that are forests are stitched by links and only others gathered:
    the sessions are the same.
    """
    by = keys.document(pairs, doc)
    key = [*by, "chunk_id", "role_a", "role_b", "session", "place"]
    if _is_long(pairs, by, bucket_rows):
        edges = cut(stitch.numbered(pairs, by))
        linked = stitch.placed(edges.where("forest"), by, max_turns).select(*key, "row")
        others = edges.where("NOT forest").select("row.*")
        folded = _folded(others, max_turns, by).select(*key, "row")
        rows = linked.unionByName(folded)
    else:
        rows = _folded(pairs, max_turns, by)
    return rows.select(F.col("row"), *key).select("row.*", *[c for c in key if c not in by])


def _folded(pairs: DataFrame, max_turns: int, by: list[str]) -> DataFrame:
    rows = _buckets(pairs, max_turns, by).select(*by, "chunk_id", "role_a", "role_b", "session", "edges", F.posexplode("places").alias("place", "at"))
    return rows.select(*by, "chunk_id", "role_a", "role_b", "session", F.col("place").cast("long").alias("place"), F.get("edges", F.col("at"))["row"].alias("row"))


def _turns(pairs: DataFrame, max_turns: int, by: list[str], bucket_rows: int) -> DataFrame:
    """Bucket columns, session, turns: its samples in order."""
    key = [*by, "chunk_id", "role_a", "role_b", "session"]
    if not _is_long(pairs, by, bucket_rows):
        return _buckets(pairs, max_turns, by).select(*key, F.transform("places", lambda i: F.get("edges", i)["row"]).alias("turns"))
    rows = sessions(pairs, max_turns, by, bucket_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("row")
    found = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", row))).alias("turns"))
    return found.select(*key, F.transform("turns", lambda t: t["row"]).alias("turns"))


def stitched(pairs: DataFrame, max_turns: int = 1, reverse: bool = False, system_text: str | None = None, system_template: str | None = None, meta: bool = False, doc: Sequence[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One record for each session, with its bucket's columns: its first sample gives two messages, each later one the side that is new."""
    by = keys.document(pairs, doc)
    key = [*by, "chunk_id", "role_a", "role_b", "session"]
    rows = _turns(pairs, max_turns, by, bucket_rows).withColumn("first", F.element_at("turns", 1))
    head = _system(system_text, system_template, "first.")
    rows = rows.withColumn("_system", head if head is not None else F.lit(None).cast("string"))
    user, assistant = (F.col("first.pair.to"), F.col("first.pair.from")) if reverse else (F.col("first.pair.from"), F.col("first.pair.to"))
    opening = ("first.reply.text", "first.source.text") if reverse else ("first.source.text", "first.reply.text")
    body = F.array(_message("user", strip(opening[0])), _message("assistant", strip(opening[1])))
    role = lambda t: F.when(t["pair"]["from"] == assistant, F.lit("user")).when(t["pair"]["from"] == user, F.lit("assistant"))
    later = F.transform(F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0))), lambda t: _message(role(t), strip(t["reply"]["text"])))
    later = F.filter(later, lambda m: m["role"].isNotNull())
    lead = F.when(F.col("_system") != "", F.array(_message("system", F.col("_system")))).otherwise(F.expr("CAST(array() AS array<struct<role: string, content: string>>)"))
    about = F.struct(*by, F.col("first.pair").alias("pair"), "chunk_id", F.size("turns").alias("turns"), F.transform("turns", lambda t: F.array(t["source"]["dialogue_index"], t["reply"]["dialogue_index"])).alias("indices"), F.transform("turns", lambda t: t["confidence"]).alias("confidences"))
    return rows.select(*key, F.concat(lead, body, later).alias("messages"), *([about.alias("meta")] if meta else []))


def convert(pairs: DataFrame, mode: str = "pair", min_confidence: float | None = None, reverse: bool = False, system_text: str | None = None, system_template: str | None = None, max_turns: int = 1, meta: bool = False, dedupe: bool = False, order: tuple[str, ...] = (), doc: Sequence[str] | None = None) -> DataFrame:
    """Samples that are usable, as records of one turn each ("pair") or of sessions ("stitch"); sessions stay within a document."""
    rows = usable(pairs, min_confidence, dedupe, order)
    if mode == "pair":
        return single_turn(rows, reverse, system_text, system_template, meta, doc)
    if mode == "stitch":
        return stitched(rows, max_turns, reverse, system_text, system_template, meta, doc)
    raise ValueError(f"unknown mode {mode!r}")


def convert_files(spark: SparkSession, inputs: list[str], output: str, mode: str = "pair", **settings) -> int:
    """Pair files, folders and patterns to one set of chat records under output; returns how many.

    Of equal texts (dedupe) the first by file and line stays. Lines that are no pair are left out.
    """
    rows = jsonl.pairs(jsonl.json_lines(spark, jsonl.discover(spark, inputs)))
    records = convert(rows, mode, order=("file", "line_no"), **settings)
    sinks.write_json_lines(records.select("messages", *[c for c in records.columns if c == "meta"]), output, "overwrite")
    return spark.read.text(output).count()


def message_rows(records: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, role, content."""
    return records.select(*keys, F.posexplode("messages").alias("pos", "m")).select(*keys, F.col("pos").cast("long").alias("pos"), "m.role", "m.content")
