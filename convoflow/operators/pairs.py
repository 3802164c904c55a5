"""Utterances into directed role-pair samples: a self-join of each utterance with the one it answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoflow import keys
from convoflow.functions.text import ALL, legal, strip
from convoflow.operators import validate as rules
from convoflow.sources import jsonl


def roles(utterances: DataFrame, doc: Sequence[str] | None = None) -> DataFrame:
    """Document columns, role, n, first_seen: each document's roles by where they are first seen."""
    by = keys.document(utterances, doc)
    return utterances.where("role IS NOT NULL").groupBy(*by, strip("role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk_id", "dialogue_index")).alias("first_seen"))


def all_ordered(roles_: DataFrame, doc: Sequence[str] | None = None) -> DataFrame:
    """Every ordered pair of two roles of a document: as many rows as there are such pairs, so for listing, not for joining."""
    by = keys.document(roles_, doc)
    names = roles_.select(*by, "role").distinct()
    others = names.select(*keys.renamed(by, "_o_"), F.col("role").alias("to_role"))
    return names.withColumnRenamed("role", "from_role").join(others, keys.same(by, "_o_") & (F.col("from_role") != F.col("to_role"))).select(*by, "from_role", "to_role")


def wanted_pairs(utterances: DataFrame, pairs: list[str] | None = None, doc: Sequence[str] | None = None) -> DataFrame:
    """Document columns, from_role, to_role: all ordered pairs, or those that "A,B" strings name; ALL on a side stands for every other role of the document."""
    spark = utterances.sparkSession
    by = keys.document(utterances, doc)
    every = all_ordered(roles(utterances, by), by)
    if not pairs or any(p.strip() in ALL for p in pairs):
        return every
    asked = [tuple(map(str.strip, p.split(",", 1))) for p in pairs if "," in p]
    if not asked:
        raise ValueError("no pair of the form 'A,B'")
    table = spark.createDataFrame([(a, b) for a, b in dict.fromkeys(asked)], "a string, b string")
    star = lambda c: F.col(c).isin(*ALL)
    exact = table.where(~star("a") & ~star("b")).select(F.col("a").alias("from_role"), F.col("b").alias("to_role"))
    if by:  # the named pairs hold for each document
        named = [F.struct(F.lit(a).alias("from_role"), F.lit(b).alias("to_role")) for a, b in dict.fromkeys(asked) if a not in ALL and b not in ALL]
        exact = utterances.select(*by).distinct().select(*by, F.explode(F.array(*named)).alias("p")).select(*by, "p.*") if named else every.limit(0)
    wild = every.join(F.broadcast(table.where(star("a") | star("b"))), (star("a") | (F.col("a") == F.col("from_role"))) & (star("b") | (F.col("b") == F.col("to_role"))), "left_semi")
    return exact.unionByName(wild).distinct()


def build_pairs(
    utterances: DataFrame,
    wanted: DataFrame | None = None,
    min_confidence: float | None = 0.8,
    strict: bool = False,
    require_confidence: bool = False,
    fallback: bool = True,
    drop_inconsistent: bool = False,
    source_chars: tuple[int | None, int | None] = (1, None),
    reply_chars: tuple[int | None, int | None] = (1, None),
    deny: list[str] | None = None,
    doc: Sequence[str] | None = None,
) -> DataFrame:
    """utterances (document columns, chunk_id, dialogue_index, role, dialogue, reply, perhaps line_no) -> document columns, source, reply, pair, confidence.

    Links and roles stay within a document, so documents may number their chunks alike (`keys` says which columns tell them
    apart). wanted: directions (from_role, to_role, for every document or with its columns); without it any two different roles
    of a document will do, and no table of them is made. A link names its target's chunk; one with a null chunk leads nowhere. Of
    utterances that repeat a key the last counts, once for each. strict: a confidence is required, the stated target role must be
    the target's, and stands in for nothing.
    """
    if strict:
        require_confidence, fallback, drop_inconsistent = True, False, True
    by = keys.document(utterances, doc)
    key = Window.partitionBy(*keys.utterance(utterances, by))
    last = F.row_number().over(key.orderBy(*keys.latest(utterances)))
    index = utterances.withColumn("_copies", F.count(F.lit(1)).over(key)).withColumn("_n", last).where("_n = 1").drop("_n")
    child = index.where("reply.target_index IS NOT NULL").select(
        *by, F.struct("chunk_id", "dialogue_index", strip("role").alias("role"), F.col("dialogue").alias("text")).alias("c"),
        F.col("reply.target_chunk_id").alias("t_chunk"), F.col("reply.target_index").alias("t_index"), strip("reply.target_role").alias("t_role"), F.col("reply.confidence").alias("confidence"), "_copies",
    )
    parent = index.select(*keys.renamed(by, "_p_"), F.struct("chunk_id", "dialogue_index", strip("role").alias("role"), F.col("dialogue").alias("text")).alias("p"), F.col("chunk_id").alias("_p_chunk"), F.col("dialogue_index").alias("_p_index"))
    target = keys.same(by, "_p_") & (F.col("t_chunk") == F.col("_p_chunk")) & (F.col("t_index") == F.col("_p_index"))
    linked = child.join(parent, target).where(~((F.col("c.chunk_id") == F.col("p.chunk_id")) & (F.col("c.dialogue_index") == F.col("p.dialogue_index"))))
    if drop_inconsistent:
        linked = linked.where("t_role IS NULL OR t_role = p.role")
    if require_confidence:
        linked = linked.where("confidence IS NOT NULL")
    if min_confidence is not None:
        linked = linked.where(F.coalesce((F.col("confidence") >= min_confidence) & ~F.isnan("confidence"), F.lit(False)))
    linked = linked.where(legal(F.col("p.text"), *source_chars, deny) & legal(F.col("c.text"), *reply_chars, deny))
    c_role, p_role, t_role = F.col("c.role"), F.col("p.role"), F.col("t_role")
    if wanted is None:
        source_role: Column = F.when(p_role != c_role, p_role)
        if fallback:
            named = roles(utterances, by).select(*keys.renamed(by, "_d_"), F.col("role").alias("_f"), F.lit(True).alias("_other"))
            linked = linked.join(named, keys.same(by, "_d_") & (t_role == F.col("_f")), "left").drop("_f")
            source_role = F.coalesce(source_role, F.when(F.col("_other") & (t_role != c_role), t_role))
    else:
        of = [c for c in by if c in wanted.columns]
        drop = ["_f", "_t", *(f"_d_{c}" for c in of)]
        direct = wanted.select(*keys.renamed(of, "_d_"), F.col("from_role").alias("_f"), F.col("to_role").alias("_t"), F.lit(True).alias("_direct"))
        linked = linked.join(direct, keys.same(of, "_d_") & (p_role == F.col("_f")) & (c_role == F.col("_t")), "left").drop(*drop)
        source_role = F.when(F.col("_direct"), p_role)
        if fallback:
            other = direct.withColumnRenamed("_direct", "_other")
            linked = linked.join(other, keys.same(of, "_d_") & (t_role == F.col("_f")) & (c_role == F.col("_t")), "left").drop(*drop)
            source_role = F.coalesce(source_role, F.when(F.col("_other"), t_role))
    linked = linked.withColumn("_role", source_role).where("_role IS NOT NULL")
    side = lambda s, role: F.struct(F.col(f"{s}.chunk_id").alias("chunk_id"), F.col(f"{s}.dialogue_index").alias("dialogue_index"), role.alias("role"), F.col(f"{s}.text").alias("text"))
    rows = linked.select(*by, side("p", F.col("_role")).alias("source"), side("c", F.col("c.role")).alias("reply"), F.struct(F.col("_role").alias("from"), F.col("c.role").alias("to")).alias("pair"), "confidence", "_copies")
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*by, "source", "reply", "pair", "confidence")


def from_lines(rows: DataFrame, wanted: list[str] | None = None, validated: bool = False, doc: Sequence[str] | None = None, **settings) -> DataFrame:
    """Raw lines (file, line_no, value, v) to samples; validated: lines that break a rule are an error before anything is paired.

    doc: ("file",) where every file is a document of its own.
    """
    if validated:
        rules.check(rows, doc)
    found = jsonl.utterances(rows)
    # All pairs of roles are a predicate; only named ones need a table.
    named = wanted and not any(p.strip() in ALL for p in wanted)
    return build_pairs(found, wanted_pairs(found, wanted, doc) if named else None, doc=doc, **settings)


def pair_counts(pairs: DataFrame, doc: Sequence[str] = ()) -> DataFrame:
    """from_role, to_role, n: over all documents, or for each where its columns are named."""
    return pairs.groupBy(*doc, F.col("pair.from").alias("from_role"), F.col("pair.to").alias("to_role")).agg(F.count(F.lit(1)).alias("n"))


def role_mentions(pairs: DataFrame) -> DataFrame:
    """How often a role is named by samples: as a pair's end, as a side's role, and in columns from_role and to_role of older samples."""
    named = ["pair.from", "pair.to", "source.role", "reply.role", *[c for c in ("from_role", "to_role") if c in pairs.columns]]
    return pairs.select(F.explode(F.array(*named)).alias("role")).where("role <> ''").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def role_mentions_of_lines(rows: DataFrame) -> DataFrame:
    """The same from raw pair lines (v), in whichever fields they name roles; lines that are no object count nothing."""
    fields = ["$.pair.from", "$.pair.to", "$.source.role", "$.reply.role", "$.from_role", "$.to_role"]
    named = F.array(*[F.try_variant_get("v", f, "string") for f in fields])
    return rows.where(jsonl.is_object(F.col("v"))).select(F.explode(named).alias("role")).where("role <> ''").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
