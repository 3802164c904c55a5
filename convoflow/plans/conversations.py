"""The conversations table as utterances, with links, confidences and faults that follow from its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, dialogue_index, role, dialogue, reply, line_no.

    A turn answers the one before, or, where (conv_id + turn) % 5 = 0, the one before that; every seventh links to nothing,
    every eleventh names a wrong role, every thirteenth has no confidence, every seventeenth a chunk that is expressly null.
    """
    rows = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 7 + F.col("turn")
    back = F.when((F.col("turn") >= 2) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), F.lit(2)).otherwise(F.lit(1))
    before = Window.partitionBy("conv_id").orderBy("turn")
    role = F.when(back == 2, F.lag("role", 2).over(before)).otherwise(F.lag("role", 1).over(before))
    link = F.struct(
        (F.col("turn") - back).cast("long").alias("target_index"),
        F.when(key % 17 != 0, F.col("conv_id")).cast("long").alias("target_chunk_id"),
        F.when(key % 11 == 0, F.lit("narrator")).otherwise(role).alias("target_role"),
        F.when(key % 13 != 0, F.lit(0.5) + ((F.col("conv_id") * 7 + F.col("turn") * 13) % 51) / F.lit(100.0)).alias("confidence"),
    )
    reply = F.when((F.col("turn") > 0) & (key % 7 != 0), link)
    return rows.select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("dialogue_index"), "role", F.col("text").alias("dialogue"), reply.alias("reply"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"))


#: The same in SQL: a prefix of every query below.
UTTERANCES_SQL = """
WITH base AS (SELECT *, conv_id * 7 + turn AS k, CASE WHEN turn >= 2 AND (conv_id + turn) % 5 = 0 THEN 2 ELSE 1 END AS back FROM conversations),
u AS (
  SELECT conv_id AS chunk_id, turn AS dialogue_index, role, text AS dialogue, conv_id * 1000 + turn AS line_no,
    CASE WHEN turn > 0 AND k % 7 <> 0 THEN turn - back END AS t_index,
    CASE WHEN turn > 0 AND k % 7 <> 0 AND k % 17 <> 0 THEN conv_id END AS t_chunk,
    CASE WHEN turn > 0 AND k % 7 <> 0 THEN CASE WHEN k % 11 = 0 THEN 'narrator' WHEN back = 2 THEN lag(role, 2) OVER w ELSE lag(role) OVER w END END AS t_role,
    CASE WHEN turn > 0 AND k % 7 <> 0 AND k % 13 <> 0 THEN 0.5::DOUBLE + ((conv_id * 7 + turn * 13) % 51) / 100.0::DOUBLE END AS confidence
  FROM base WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""


#: Conversations that are the chunks of one document.
CHUNKS = 50


def of_documents(spark: SparkSession, sf_dir: str, chunks: int = CHUNKS) -> DataFrame:
    """The same utterances as those of documents of so many conversations each: doc_id, and chunk_id and targets that every document counts from 0."""
    rows = utterances(spark, sf_dir)
    target = F.when(F.col("reply").isNotNull(), F.col("reply").withField("target_chunk_id", F.col("reply.target_chunk_id") % chunks))
    return rows.withColumns({"doc_id": F.floor(F.col("chunk_id") / chunks).cast("long"), "chunk_id": F.col("chunk_id") % chunks, "reply": target})


def documents_sql(chunks: int = CHUNKS) -> str:
    found = UTTERANCES_SQL.replace("conv_id AS chunk_id", f"conv_id // {chunks} AS doc_id, conv_id % {chunks} AS chunk_id")
    return found.replace("THEN conv_id END AS t_chunk", f"THEN conv_id % {chunks} END AS t_chunk")


DOCUMENTS_SQL = documents_sql()


def by_document(sql: str) -> str:
    """A query by chunks as one by documents and chunks."""
    for one, both in (
        ("SELECT chunk_id", "SELECT doc_id, chunk_id"), ("SELECT c.chunk_id", "SELECT c.doc_id, c.chunk_id"), ("SELECT e.chunk_id", "SELECT e.doc_id, e.chunk_id"),
        ("BY chunk_id", "BY doc_id, chunk_id"), ("p.chunk_id = c.t_chunk", "p.doc_id = c.doc_id AND p.chunk_id = c.t_chunk"), ("y.chunk_id = x.chunk_id", "y.doc_id = x.doc_id AND y.chunk_id = x.chunk_id"),
        ("e.chunk_id = w.chunk_id", "e.doc_id = w.doc_id AND e.chunk_id = w.chunk_id"), ("(SELECT role FROM u)", "(SELECT x.role FROM u x WHERE x.doc_id = c.doc_id)"),
        ("SELECT line_no", "SELECT doc_id, line_no"), ("BY chunk,", "BY doc_id, chunk,"), ("SELECT chunk,", "SELECT doc_id, chunk,"), ("GROUP BY chunk\n", "GROUP BY doc_id, chunk\n"),
        ("ON s.chunk = g.tc", "ON s.doc_id = g.doc_id AND s.chunk = g.tc"), ("t.rule IS NULL AND", "t.rule IS NULL AND t.doc_id = g.doc_id AND"), ("SELECT NULL, NULL, NULL, 'E_EMPTY' WHERE NOT EXISTS (SELECT 1 FROM r WHERE chunk >= 0)", "SELECT doc_id, NULL, NULL, NULL, 'E_EMPTY' FROM r GROUP BY doc_id HAVING coalesce(max(chunk), -1) < 0"),
    ):
        sql = sql.replace(one, both)
    return sql


def raw_lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """line_no (and doc_id) and value: the utterances as JSON lines, with a fault of each kind in some of them."""
    rows = (utterances(spark, sf_dir) if rows is None else rows).withColumn("f", F.pmod(F.col("chunk_id") * 31 + F.col("dialogue_index") * 7, F.lit(40)))
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    index = F.when(F.col("f") == 3, F.lit("-1")).when((F.col("f") == 4) & (F.col("dialogue_index") > 0), (F.col("dialogue_index") - 1).cast("string")).when(F.col("f") == 5, (F.col("dialogue_index") + 100).cast("string")).otherwise(F.col("dialogue_index").cast("string"))
    target = F.when(F.col("f") == 9, F.lit("true")).when(F.col("f") == 10, F.col("dialogue_index").cast("string")).otherwise(F.col("reply.target_index").cast("string"))
    chunk = F.when(F.col("f") == 11, F.lit(', "target_chunk_id": null')).when(F.col("f") == 12, F.lit(', "target_chunk_id": 99999999')).when(F.col("f") == 13, F.concat(F.lit(', "target_chunk_id": '), (F.col("chunk_id") + 1).cast("string"))).otherwise(F.lit(""))
    role = F.when(F.col("f") == 15, F.lit("5")).otherwise(F.concat(F.lit('"'), F.col("reply.target_role"), F.lit('"')))
    confidence = F.when(F.col("f") == 14, F.lit("1.5")).otherwise(F.coalesce(F.col("reply.confidence").cast("string"), F.lit("null")))
    link = F.when(F.col("reply").isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"target_index": '), target, chunk, F.lit(', "target_role": '), role, F.lit(', "confidence": '), confidence, F.lit("}")))
    link = F.when(F.col("f") == 8, F.lit('"x"')).otherwise(link)
    whole = F.concat(
        F.lit('{"chunk_id": '), F.when(F.col("f") == 2, F.lit("true")).otherwise(F.col("chunk_id").cast("string")), F.lit(', "dialogue_index": '), index,
        F.lit(', "role": '), F.when(F.col("f") == 6, F.lit('" "')).otherwise(quoted("role")), F.lit(', "dialogue": '), F.when(F.col("f") == 7, F.lit('""')).otherwise(quoted("dialogue")), F.lit(', "reply": '), link, F.lit("}"),
    )
    return rows.select(*[c for c in ("doc_id",) if c in rows.columns], "line_no", F.when(F.col("f") == 0, F.lit('{"chunk_id":')).when(F.col("f") == 1, F.lit("[1]")).otherwise(whole).alias("value"))


#: Errors of the raw lines in SQL: the faults by number, as they are put in above, and then the rules by their order.
ERRORS_SQL = """, raw AS (
  SELECT *, (chunk_id * 31 + dialogue_index * 7) % 40 AS f, t_index IS NOT NULL AS has_link FROM u
), l AS (
  SELECT line_no, f, has_link, dialogue_index AS was, CASE WHEN f > 2 THEN chunk_id END AS chunk,
    CASE WHEN f IN (0, 1) THEN NULL WHEN f = 3 THEN -1 WHEN f = 4 AND dialogue_index > 0 THEN dialogue_index - 1 WHEN f = 5 THEN dialogue_index + 100 ELSE dialogue_index END AS idx,
    CASE WHEN f = 9 THEN NULL WHEN f = 10 THEN dialogue_index ELSE t_index END AS ti,
    CASE WHEN f = 11 THEN NULL WHEN f = 12 THEN 99999999 WHEN f = 13 THEN chunk_id + 1 ELSE chunk_id END AS tc,
    CASE WHEN f = 14 THEN 1.5::DOUBLE ELSE confidence END AS confidence, f = 15 AND t_role IS NOT NULL AS bad_role FROM raw
), d AS (
  SELECT *, row_number() OVER (PARTITION BY chunk, idx, idx >= 0 ORDER BY line_no) AS turn FROM l
), r AS (
  SELECT *, CASE WHEN f = 0 THEN 'E_JSON' WHEN f = 1 THEN 'E_NOT_OBJECT' WHEN f = 2 THEN 'E_CHUNK_ID' WHEN idx < 0 THEN 'E_INDEX' WHEN turn > 1 THEN 'E_DUP_INDEX'
    WHEN f = 6 THEN 'E_ROLE' WHEN f = 7 THEN 'E_DIALOGUE' WHEN f = 8 THEN 'E_REPLY_TYPE' END AS rule FROM d
), g AS (
  SELECT *, row_number() OVER (PARTITION BY chunk, rule IS NULL ORDER BY idx) - 1 AS rank FROM r
), sizes AS (SELECT chunk, count(*) FILTER (WHERE rule IS NULL) AS size FROM r WHERE chunk IS NOT NULL GROUP BY chunk
), k AS (
  SELECT g.*, CASE WHEN coalesce(g.ti < 0, true) THEN 'E_TARGET_INDEX' WHEN g.tc IS NULL THEN 'E_TARGET_CHUNK' WHEN s.chunk IS NULL THEN 'E_TARGET_CHUNK_MISSING'
    WHEN g.tc = g.chunk AND g.ti >= g.idx THEN 'E_NOT_EARLIER' WHEN g.tc > g.chunk THEN 'E_FUTURE_CHUNK' WHEN g.tc <> g.chunk AND g.ti >= s.size THEN 'E_RANGE' WHEN t.idx IS NULL THEN 'E_TARGET_MISSING' END AS link
  FROM g LEFT JOIN sizes s ON s.chunk = g.tc LEFT JOIN r t ON t.rule IS NULL AND t.chunk = g.tc AND t.idx = g.ti WHERE g.rule IS NULL AND g.has_link
), e AS (
  SELECT line_no, chunk, idx, rule AS code FROM g WHERE rule IS NOT NULL
  UNION ALL SELECT line_no, chunk, idx, 'E_GAP' FROM g WHERE rule IS NULL AND rank <> idx
  UNION ALL SELECT line_no, chunk, idx, link FROM k WHERE link IS NOT NULL
  UNION ALL SELECT line_no, chunk, idx, 'E_CONFIDENCE' FROM k WHERE link IS NULL AND coalesce(confidence NOT BETWEEN 0 AND 1, true)
  UNION ALL SELECT line_no, chunk, idx, 'E_TARGET_ROLE' FROM k WHERE link IS NULL AND bad_role
  UNION ALL SELECT NULL, NULL, NULL, 'E_EMPTY' WHERE NOT EXISTS (SELECT 1 FROM r WHERE chunk >= 0)
)
SELECT line_no, chunk AS chunk_id, idx AS dialogue_index, code FROM e"""
