"""Model responses into utterances."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoflow.functions.text import strip
from convoflow.keys import renamed, same
from convoflow.operators import schema as schemas
from convoflow.sources.jsonl import at, is_object, kind

#: Reasoning blocks and code fences.
REASONING = r"(?is)<think>.*?</think>"
CLOSING = "</think>"
FENCE = r"(?im)^```(?:json)?\s*|\s*```$"


def strip_reasoning(text: Column) -> Column:
    """Without reasoning blocks; where only a closing tag is left, what follows the first one."""
    rest = F.regexp_replace(text, REASONING, "")
    place = F.instr(rest, CLOSING)
    return strip(F.when(place > 0, F.substring(rest, place + len(CLOSING), F.length(rest))).otherwise(rest))


def strip_fence(text: Column) -> Column:
    return F.regexp_replace(strip(text), FENCE, "")


#: A string, closed or not, or a bracket outside strings.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]]', re.S)


def _closings(text: str, start: int) -> dict[int, int | None]:
    """Every bracket that opens from start on, outside strings, and the place behind the one that closes it."""
    found: dict[int, int | None] = {}
    open_: list[int] = []
    for token in _TOKEN.finditer(text, start):
        if token[0] == "[":
            open_.append(token.start())
            found[token.start()] = None
        elif token[0] == "]" and open_:
            found[open_.pop()] = token.end()
    return found


def first_array(text: str | None) -> str | None:
    """The first stretch of a text, by where it starts, that reads as a JSON list. One nested too deeply to be read is none."""
    text = text or ""
    ends: dict[int, int | None] = {}
    start = text.find("[")
    while start >= 0:
        if start not in ends:  # the first, or one within what was taken for a string
            ends |= _closings(text, start)
        if end := ends[start]:
            try:
                json.loads(text[start:end])
                return text[start:end]
            except (ValueError, RecursionError):
                pass
        start = text.find("[", start + 1)
    return None


def _arrays(texts: pa.Array) -> pa.Array:
    return pa.array([first_array(t) for t in texts.to_pylist()], pa.string())


def script(responses: DataFrame, fail_on_parse_error: bool = False) -> DataFrame:
    """responses (..., response) plus items (a variant list, or null) and parse_status: ok or failed.

    The response is read as it is; only one that is no JSON at all is searched for its first list, without its fence. One that
    has none is a row that says so, or, if asked for, an error of the whole run.
    """
    whole = F.try_parse_json(F.coalesce("response", F.lit("")))
    rows = responses.withColumn("_whole", whole).withColumn("_bare", strip_fence(F.coalesce("response", F.lit("")))).withColumn("_inner", F.try_parse_json("_bare"))

    def listed(v: Column) -> Column:
        inner = at(v, "$.script")
        return F.when(F.startswith(kind(v), F.lit("ARRAY")), v).when(F.startswith(kind(inner), F.lit("ARRAY")), inner)

    searched = F.try_parse_json(F.arrow_udf(_arrays, "string")("_bare"))
    broken = rows.where("_whole IS NULL").withColumn("items", F.coalesce(listed(F.col("_inner")), searched))
    read = rows.where("_whole IS NOT NULL").withColumn("items", listed(F.col("_whole")))
    out = read.unionByName(broken).drop("_whole", "_bare", "_inner")
    bad = F.raise_error(F.concat(F.lit("no JSON list in response: "), F.substring(F.regexp_replace(F.coalesce("response", F.lit("")), r"\s+", " "), 1, 400))) if fail_on_parse_error else F.lit("failed")
    return out.withColumn("parse_status", F.when(F.col("items").isNull(), bad).otherwise(F.lit("ok")))


def clean_reply(index: Column, target: Column, confidence: Column, window: int = 6, threshold: float = 0.65) -> Column:
    """Whether a reply link is kept: an earlier target within the window, and a confidence that is a number of at least the threshold."""
    return F.coalesce((target >= 0) & (target < index) & (index - target <= window) & ~F.isnan(confidence) & (confidence >= threshold), F.lit(False))


def utterances(parsed: DataFrame, keys: tuple[str, ...] = ("chunk_id",), window: int = 6, threshold: float = 0.65, schema: schemas.Schema | None = None, remap: bool = False) -> DataFrame:
    """parsed (keys, items) -> keys, dialogue_index, role, dialogue, reply, and the schema's attributes: items with a role and a dialogue, numbered from 0.

    Replies stay within their chunk. A target is the number that an item has among those that are kept, or with `remap` the one
    that the model gave it, its place in the list as it came: links then lead to the item that was meant, and one whose target
    was left out leads nowhere. The window and the order are those of the kept items either way.
    """
    items = parsed.where("items IS NOT NULL").select(*keys, F.posexplode(F.col("items").cast("array<variant>")).alias("at", "item"))
    text = lambda path: F.when(at(F.col("item"), path).isNotNull() & (kind(at(F.col("item"), path)) != "VOID"), strip(F.try_variant_get("item", path, "string")))
    rows = items.where(is_object(F.col("item"))).select(*keys, "at", "item", text("$.role").alias("role"), text("$.dialogue").alias("dialogue")).where("role <> '' AND dialogue <> ''")
    by = [k for k in keys if k != "chunk_text"]
    rows = rows.withColumn("dialogue_index", (F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1).cast("long"))
    reply = at(F.col("item"), "$.reply")
    number = kind(at(reply, "$.confidence")).isNull() | kind(at(reply, "$.confidence")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    target = F.when(kind(at(reply, "$.target_index")) == "BIGINT", F.try_variant_get(reply, "$.target_index", "bigint"))
    if remap:
        meant = rows.select(*renamed(by, "_m_"), F.col("at").cast("long").alias("_at"), F.col("dialogue_index").alias("_meant"))
        rows = rows.withColumn("_target", target).join(meant, same(by, "_m_") & (F.col("_target") == F.col("_at")), "left")
        target = F.col("_meant")
    confidence = F.when(number, F.coalesce(F.try_variant_get(reply, "$.confidence", "double"), F.lit(1.0)))
    link = F.struct(target.alias("target_index"), (F.col("chunk_id") if "chunk_id" in keys else F.lit(None)).cast("long").alias("target_chunk_id"), F.try_variant_get(reply, "$.target_role", "string").alias("target_role"), confidence.alias("confidence"))
    kept = is_object(reply) & clean_reply(F.col("dialogue_index"), target, confidence, window, threshold)
    return rows.select(*keys, "dialogue_index", "role", "dialogue", F.when(kept, link).alias("reply"), *(schema.columns(F.col("item")) if schema else []))
