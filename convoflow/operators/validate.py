"""Data-quality rules over raw utterance lines: one table of errors; no errors, no findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoflow import keys
from convoflow.functions.text import strip
from convoflow.operators import schema as schemas
from convoflow.sources.jsonl import as_lines, at, is_object, kind

ERRORS = ["line_no", "chunk_id", "dialogue_index", "code"]


def _whole(v: Column) -> Column:
    """A JSON integer that is not negative, else null."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).cast("long")


def _number(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def _read(rows: DataFrame, by: list[str], schema: schemas.Schema | None) -> DataFrame:
    """Every line once: its keys, whether it is usable, and the first rule of its own that it breaks; turn is its place among lines of its key."""
    v = F.col("v")
    chunk, index = _whole(at(v, "$.chunk_id")), _whole(at(v, "$.dialogue_index"))
    text = lambda path: F.coalesce((kind(at(v, path)) == "STRING") & (strip(F.try_variant_get(v, path, "string")) != ""), F.lit(False))
    reply = at(v, "$.reply")
    lines = rows.select(*by, "line_no", F.when(is_object(v), chunk).alias("chunk_id"), F.when(is_object(v), index).alias("dialogue_index"), F.when(is_object(reply), reply).alias("r"),
        (is_object(v) & F.coalesce(chunk >= 0, F.lit(False))).alias("usable"),
        F.when(v.isNull(), F.lit("E_JSON")).when(~is_object(v), F.lit("E_NOT_OBJECT")).otherwise(F.lit("E_CHUNK_ID")).alias("_line"),
        F.when(~text("$.role"), F.lit("E_ROLE")).when(~text("$.dialogue"), F.lit("E_DIALOGUE")).when(~(reply.isNull() | (kind(reply) == "VOID") | is_object(reply)), F.lit("E_REPLY_TYPE")).otherwise(schema.rule(v, F.lit(None)) if schema else F.lit(None)).alias("_content"))
    # Lines without a chunk are a rule's breach already: they need no window, and are spread over groups of their own.
    lines = lines.withColumn("_group", F.when(F.col("usable"), F.col("chunk_id")).otherwise(-1 - F.pmod(F.xxhash64("line_no"), F.lit(4096))))
    good = F.coalesce(F.col("dialogue_index") >= 0, F.lit(False))
    turn = F.row_number().over(Window.partitionBy(*by, "_group", "dialogue_index", good).orderBy("line_no"))
    rule = F.when(~F.col("usable"), F.col("_line")).when(~good, F.lit("E_INDEX")).when(F.col("_turn") > 1, F.lit("E_DUP_INDEX")).otherwise(F.col("_content"))
    return lines.withColumn("_turn", turn).withColumn("rule", rule).drop("_line", "_content", "_turn")


def errors(rows: DataFrame, doc: Sequence[str] | None = None, schema: schemas.Schema | None = None) -> DataFrame:
    """rows (document columns, line_no, v: a variant) -> document columns, line_no, chunk_id, dialogue_index, code, one row for each broken rule.

    Typed utterances, as a run returns them, are read as the lines that they would be. Every rule is kept within a document:
    chunks, numbers and targets of another one do not count, and each document without a usable line is empty. Lines are read
    once for their own rules, those of a schema's attributes among them; the targets of replies are looked up among them by two joins on their keys.
    """
    by = keys.document(rows, doc)
    rows = rows if "v" in rows.columns else as_lines(rows, by, schemas.names(schema))
    read = _read(rows, by, schema)
    sound = read.where("usable AND rule IS NULL")
    chunks = read.where("usable").groupBy(*keys.renamed(by, "_c_"), F.col("chunk_id").alias("_t")).agg(F.count_if(F.col("rule").isNull()).alias("_size"))
    targets = sound.select(*keys.renamed(by, "_t_"), F.col("chunk_id").alias("_tc"), F.col("dialogue_index").alias("_ti"), F.lit(True).alias("_there"))
    whole = F.col("rule").isNull()
    rank = F.row_number().over(Window.partitionBy(*by, "_group", whole).orderBy("dialogue_index")) - 1
    r, own = F.col("r"), F.col("tc") == F.col("chunk_id")
    given = at(r, "$.target_chunk_id")
    lines = read.withColumns({
        "_gap": F.when(whole & (rank != F.col("dialogue_index")), F.lit("E_GAP")),
        "ti": F.when(whole, _whole(at(r, "$.target_index"))),
        "tc": F.when(whole & r.isNotNull(), F.when(given.isNull(), F.col("chunk_id")).otherwise(_whole(given))),
        "_confidence": F.when(~F.coalesce(_number(r, "$.confidence").between(0, 1) & ~F.isnan(_number(r, "$.confidence")), F.lit(False)), F.lit("E_CONFIDENCE")),
        "_role": F.when(~F.coalesce(kind(at(r, "$.target_role")).isin("STRING", "VOID"), F.lit(True)), F.lit("E_TARGET_ROLE")),
        "_linked": whole & r.isNotNull(),
    })
    lines = lines.drop("r").join(chunks, keys.same(by, "_c_") & (F.col("tc") == F.col("_t")), "left")
    lines = lines.join(targets, keys.same(by, "_t_") & (F.col("tc") == F.col("_tc")) & (F.col("ti") == F.col("_ti")), "left")
    broken = (
        F.when(~F.coalesce(F.col("ti") >= 0, F.lit(False)), F.lit("E_TARGET_INDEX"))
        .when(~F.coalesce(F.col("tc") >= 0, F.lit(False)), F.lit("E_TARGET_CHUNK"))
        .when(F.col("_t").isNull(), F.lit("E_TARGET_CHUNK_MISSING"))
        .when(own & (F.col("ti") >= F.col("dialogue_index")), F.lit("E_NOT_EARLIER"))
        .when(~own & (F.col("tc") > F.col("chunk_id")), F.lit("E_FUTURE_CHUNK"))
        .when(~own & (F.col("ti") >= F.col("_size")), F.lit("E_RANGE"))
        .when(F.col("_there").isNull(), F.lit("E_TARGET_MISSING"))
    )
    lines = lines.withColumn("_link", F.when(F.col("_linked"), broken))
    fits = F.col("_linked") & F.col("_link").isNull()
    codes = F.array_compact(F.array("rule", "_gap", "_link", F.when(fits, F.col("_confidence")), F.when(fits, F.col("_role"))))
    found = lines.select(*by, *ERRORS[:3], F.explode(codes).alias("code"))
    usable = is_object(F.col("v")) & F.coalesce(_whole(at(F.col("v"), "$.chunk_id")) >= 0, F.lit(False))
    none = [F.lit(None).cast("long").alias(c) for c in ERRORS[:3]] + [F.lit("E_EMPTY").alias("code")]
    empty = rows.groupBy(*by).agg(F.count_if(usable).alias("n")).where("n = 0").select(*by, *none)
    if by:  # no document at all is as empty as one without lines
        nothing = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
        empty = empty.unionByName(nothing.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by], *none))
    return found.unionByName(empty)


def passes(rows: DataFrame, doc: Sequence[str] | None = None, schema: schemas.Schema | None = None) -> bool:
    return errors(rows, doc, schema).isEmpty()


def check(rows: DataFrame, doc: Sequence[str] | None = None, schema: schemas.Schema | None = None) -> None:
    """An error that lists the first findings, if there are any."""
    found = errors(rows, doc, schema).orderBy(F.col("line_no").asc_nulls_first(), "code").take(5)
    if found:
        raise ValueError("lines break rules: " + "; ".join(f"line {r['line_no']}: {r['code']}" for r in found))


def validated_copy(rows: DataFrame, path: str) -> bool:
    """Lines (line_no, value, v) that break no rule, written as they are in their order; False, and no copy, if any does."""
    if not passes(rows):
        return False
    rows.orderBy(*[c for c in ("file", "line_no") if c in rows.columns]).select("value").write.text(path)
    return True
