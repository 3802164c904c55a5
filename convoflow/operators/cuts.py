"""The same chunks as `segment.fold` finds, from rows of lines: by prefix sums, range lookups and pointer jumping.

What a chunk that begins with line i holds depends on i alone: the lines before it that fit the overlap, and those from it on that
fit the rest. Both ends are range lookups in prefix sums, and a chunk reaches over fewer lines than it may hold tokens; so lines
are dealt into blocks of that many, each with as many of its neighbours as a chunk can reach, and a document's lines spread over tasks however long it is. The
line that no longer fits begins the next chunk: that is a pointer from line to line. The lines where chunks really begin are those
that pointers lead to from the first one, found by doubling: in round k pointers jump 2^k chunks. A line above the limit ends what
is before it, is cut into sentences by itself, and lets the next line begin anew.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoflow import keys
from convoflow.functions.text import sentences
from convoflow.operators import segment
from convoflow.shared import cut, small_batches, text_runs, tidy


def packed(line: Column, limit: int) -> Column:
    """The sentences of a line, joined while they stay within the limit in characters."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, part: Column) -> Column:
        joins = acc["last"].isNotNull() & (F.length(acc["last"]) + F.length(part) <= limit)
        out = F.when(joins | acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"]))
        return F.struct(out.alias("out"), F.when(joins, F.concat(acc["last"], part)).otherwise(part).alias("last"))

    return F.aggregate(sentences(line), start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])))


def _measured(tokens: segment.Tokens, limit: int):
    """A line's tokens and, if they are above the limit, what it is cut into."""
    kind = pa.struct([("size", pa.int64()), ("pieces", pa.list_(pa.string()))])

    def run(lines: pa.Array) -> pa.Array:
        made = []
        for part in text_runs(lines):
            sizes = iter(segment._sizes(tokens, [x for x in part if x is not None]))
            found = [(x, None if x is None else next(sizes)) for x in part]
            made.append(pa.array([{"size": n, "pieces": segment.cut_line(x, tokens, limit) if n is not None and n > limit else None} for x, n in found], kind))
        tidy()
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return F.arrow_udf(run, "struct<size: bigint, pieces: array<string>>")


def _found(rows: DataFrame, by: list[str], point: Column, asked: Column, strict: bool, name: str) -> DataFrame:
    """rows plus name (line, point): the first line whose point (rising along a block) is above what a row asks for, or also equal to it.

    Points and questions of a block are sorted together, greatest first: the last line seen before a question is its answer.
    """
    names = rows.columns
    line = F.struct(F.col("line_no").alias("line"), point.alias("point"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("asks"), point.alias("v"), line.alias("at")), F.struct(F.lit(True).alias("asks"), asked.alias("v"), F.lit(None).cast("struct<line: bigint, point: bigint>").alias("at"))))
    ties = F.desc("_x.asks") if strict else F.asc("_x.asks")
    before = Window.partitionBy(*by, "block").orderBy(F.desc("_x.v"), ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*names, both.alias("_x")).withColumn(name, F.last("_x.at", ignorenulls=True).over(before)).where("_x.asks").select(*names, name)


def pointers(lines: DataFrame, by: list[str], max_tokens: int, cover_tokens: int) -> DataFrame:
    """lines (document columns, line_no from 0 on without gaps, size) -> document columns, line_no, long, first, until, follows, begins.

    A chunk that begins with a line holds the lines from `first` to before `until`; the next begins with `follows`, if anything
    does; `begins`: whether a chunk begins here in any case.
    """
    size = F.greatest(F.col("size"), F.lit(1)).cast("long")
    # A chunk reaches over no more lines than half its tokens, and an overlap over no more than its own.
    lines_a_block, ahead, behind = max(max_tokens, 16), max_tokens // 2 + 2, max(cover_tokens, 1)
    own = F.floor(F.col("line_no") / lines_a_block).cast("long")
    rows = lines.select(*by, "line_no", size.alias("size"), (F.col("size") > max_tokens).alias("long"), own.alias("own"))
    place = F.col("line_no") - F.col("own") * lines_a_block
    before, after = F.when((place < ahead) & (F.col("own") > 0), F.col("own") - 1), F.when(place >= lines_a_block - behind, F.col("own") + 1)
    rows = rows.withColumn("block", F.explode(F.array_compact(F.array("own", before, after))))
    block = Window.partitionBy(*by, "block")
    along = block.orderBy("line_no")
    # Sums before a line, of sizes and of sizes with their line breaks, from the block's first neighbour on.
    rows = rows.withColumns({
        "p": F.sum("size").over(along) - F.col("size"), "q": F.sum(F.col("size") + 1).over(along) - F.col("size") - 1,
        "begins": F.coalesce(F.lag("long").over(along), F.lit(True)) & ~F.col("long"), "end": F.max("line_no").over(block) + 1,
    })
    rows = _found(rows, by, F.col("p"), F.col("p") - cover_tokens, False, "_first")
    cover = F.col("p") - F.col("_first.point")
    fits = cover + F.col("size") + 1 <= max_tokens
    rows = rows.withColumns({"first": F.when(fits, F.col("_first.line")).otherwise(F.col("line_no")), "cover": F.when(fits, cover).otherwise(F.lit(0).cast("long"))})
    upto = F.col("q") + F.col("size") + 1
    rows = _found(rows.drop("_first"), by, upto, F.greatest(F.col("q") + max_tokens - F.col("cover"), upto), True, "_until").where("block = own")
    rows = rows.withColumn("until", F.coalesce("_until.line", "end"))
    return rows.select(*by, "line_no", "long", "first", "until", F.when(F.col("until") < F.col("end"), F.col("until")).alias("follows"), "begins")


def begun(found: DataFrame, by: list[str]) -> DataFrame:
    """Document columns and line_no of the lines that pointers lead to from those that begin in any case, found by doubling."""
    ends = found.where("NOT long").select(*keys.renamed(by, "_e_"), F.col("line_no").alias("_end"))
    jumps = found.where("NOT long AND follows IS NOT NULL").select(*by, F.col("line_no").alias("a"), F.col("follows").alias("b"))
    jumps = cut(jumps.join(ends, keys.same(by, "_e_") & (F.col("b") == F.col("_end")), "left_semi"))
    reached = cut(found.where("begins").select(*by, "line_no"))
    while not jumps.isEmpty():
        other = jumps.select(*keys.renamed(by, "_j_"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        new = reached.join(other, keys.same(by, "_j_") & (F.col("line_no") == F.col("_a"))).select(*by, F.col("_b").alias("line_no"))
        reached = cut(reached.unionByName(new).distinct())
        jumps = cut(jumps.join(other, keys.same(by, "_j_") & (F.col("b") == F.col("_a"))).select(*by, "a", F.col("_b").alias("b")))
    return reached


def segment_lines(lines: DataFrame, tokens: segment.Tokens | None = None, max_tokens: int = 1000, cover_tokens: int = 100, doc: Sequence[str] | None = None) -> DataFrame:
    """lines (document columns, line_no, line: stripped and not blank) -> document columns, chunk_id (from 0 in each), chunk_text.

    tokens: counts a text's tokens, characters by default and then without Python; a line has one at least. line_no numbers the
    lines of a document from 0 without gaps, as `segment.clean_lines` does. No lines give no chunks; a null document is one like
    any other; lines that repeat a number are not allowed.
    """
    by = keys.document(lines, doc)
    lines = lines.select(*by, F.col("line_no").cast("long").alias("line_no"), "line")
    # Only sizes are kept, and the pieces of long lines where a function counts tokens; lines are read again where chunks are written.
    if tokens is None:
        sized = cut(lines.select(*by, "line_no", F.length("line").cast("long").alias("size")))
        long = lines.where(F.length("line") > max_tokens).select(*by, "line_no", packed(F.col("line"), max_tokens).alias("_pieces"))
    else:
        small_batches(lines.sparkSession)
        measured = cut(lines.select(*by, "line_no", _measured(tokens, max_tokens)("line").alias("_m")))
        sized = measured.select(*by, "line_no", F.col("_m.size").alias("size"))
        long = measured.where("_m.pieces IS NOT NULL").select(*by, "line_no", F.col("_m.pieces").alias("_pieces"))
    found = cut(pointers(sized, by, max_tokens, cover_tokens))
    starts = begun(found, by).select(*keys.renamed(by, "_s_"), F.col("line_no").alias("_start"))
    whole = found.join(starts, keys.same(by, "_s_") & (F.col("line_no") == F.col("_start")), "left_semi")
    # The pieces of long lines stand where their line does.
    long = long.select(*by, "line_no", F.posexplode("_pieces").alias("part", "chunk_text"))
    none = F.lit(None).cast("long")
    places = whole.select(*by, "line_no", F.lit(0).alias("part"), "first", "until").unionByName(long.select(*by, "line_no", "part", none.alias("first"), none.alias("until")))
    chunk_id = (F.row_number().over(Window.partitionBy(*by).orderBy("line_no", "part")) - 1).cast("long")
    places = cut(places.withColumn("chunk_id", chunk_id))
    held = places.where("first IS NOT NULL").select(*by, "chunk_id", F.explode(F.sequence("first", F.col("until") - 1)).alias("_at"))
    text = lines.select(*keys.renamed(by, "_t_"), F.col("line_no").alias("_line"), "line")
    joined = held.join(text, keys.same(by, "_t_") & (F.col("_at") == F.col("_line"))).groupBy(*by, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("lines"))
    made = joined.select(*by, "chunk_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("chunk_text"))
    named = places.where("first IS NULL").select(*keys.renamed(by, "_n_"), F.col("line_no").alias("_line"), F.col("part").alias("_part"), "chunk_id")
    cut_up = long.join(named, keys.same(by, "_n_") & (F.col("line_no") == F.col("_line")) & (F.col("part") == F.col("_part")))
    return made.unionByName(cut_up.select(*by, "chunk_id", "chunk_text"))


def segment_rows(docs: DataFrame, tokens: segment.Tokens | None = None, max_tokens: int = 1000, cover_tokens: int = 100) -> DataFrame:
    """docs (doc_id, text) as `segment.segment` cuts them, by rows of lines."""
    return segment_lines(segment.clean_lines(docs), tokens, max_tokens, cover_tokens)
