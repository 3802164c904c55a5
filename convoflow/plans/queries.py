"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoflow import sql as surface
from convoflow.functions import text
from convoflow.operators import chat, cuts, pairs, parse, segment, stats, validate
from convoflow.operators.schema import Attribute, Schema
from convoflow.streaming import resume

from .conversations import DOCUMENTS_SQL, ERRORS_SQL, UTTERANCES_SQL, by_document, documents_sql, of_documents, raw_lines, table, utterances

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What strip() and the control-character rule are in SQL.
WHITE_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
LEGAL_SQL = r"(length(trim({c}, " + WHITE_SQL + r")) >= 1 AND NOT contains({c}, chr(65533)) AND NOT regexp_matches({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]'))"


def query(sql: str | None = None, base: str | None = UTTERANCES_SQL):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{base}\n{sql}" if base else sql
        return f

    return put


def _samples(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return pairs.build_pairs(utterances(spark, sf_dir), **settings)


def _flat(samples: DataFrame, *doc: str) -> DataFrame:
    return samples.select(
        *doc, F.col("source.chunk_id").alias("chunk_id"), F.col("source.dialogue_index").alias("source_index"), F.col("reply.dialogue_index").alias("reply_index"),
        F.col("pair.from").alias("from_role"), F.col("pair.to").alias("to_role"), F.col("source.text").alias("source_text"), F.col("reply.text").alias("reply_text"), "confidence",
    )


def _pairs_sql(strict: bool, least: float | None) -> str:
    source = "p.role" if strict else "CASE WHEN p.role <> c.role THEN p.role WHEN c.t_role IN (SELECT role FROM u) AND c.t_role <> c.role THEN c.t_role END"
    return f"""SELECT * FROM (SELECT c.chunk_id, p.dialogue_index AS source_index, c.dialogue_index AS reply_index, {source} AS from_role, c.role AS to_role, p.dialogue AS source_text, c.dialogue AS reply_text, c.confidence
FROM u c JOIN u p ON p.chunk_id = c.t_chunk AND p.dialogue_index = c.t_index
WHERE {LEGAL_SQL.format(c="p.dialogue")} AND {LEGAL_SQL.format(c="c.dialogue")} {"AND c.t_role = p.role AND p.role <> c.role" if strict else ""} {f"AND c.confidence >= {least}" if least is not None else ""}) WHERE from_role IS NOT NULL"""


@query(_pairs_sql(True, 0.8))
def pairs_strict(spark, sf_dir):
    return _flat(_samples(spark, sf_dir, strict=True))


@query(_pairs_sql(False, None))
def pairs_relaxed(spark, sf_dir):
    return _flat(_samples(spark, sf_dir, min_confidence=None))


@query("SELECT a.role AS from_role, b.role AS to_role FROM (SELECT DISTINCT role FROM u) a, (SELECT DISTINCT role FROM u) b WHERE a.role <> b.role")
def pairs_all_ordered(spark, sf_dir):
    return pairs.wanted_pairs(utterances(spark, sf_dir))


@query("SELECT r.role AS from_role, 'assistant' AS to_role FROM (SELECT DISTINCT role FROM u) r WHERE r.role <> 'assistant'")
def pairs_wildcard(spark, sf_dir):
    return pairs.wanted_pairs(utterances(spark, sf_dir), ["ALL,assistant"])


@query(f"SELECT from_role, to_role, count(*) AS n FROM ({_pairs_sql(True, 0.8)}) GROUP BY ALL")
def pair_sample_counts(spark, sf_dir):
    return pairs.pair_counts(_samples(spark, sf_dir, strict=True))


@query(f"SELECT role, 2 * count(*)::BIGINT AS n FROM (SELECT unnest([from_role, to_role]) AS role FROM ({_pairs_sql(True, 0.8)})) GROUP BY role")
def pair_role_mentions(spark, sf_dir):
    return pairs.role_mentions(_samples(spark, sf_dir, strict=True))


@query(f"SELECT doc_id, {LEGAL_SQL.format(c='text')} AS legal FROM documents", None)
def text_legality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.legal(F.col("text")).alias("legal"))


@query("SELECT role, count(*) AS n, sum(length(dialogue))::BIGINT AS chars, round(avg(length(dialogue)), 6) AS average FROM u GROUP BY role")
def role_stats(spark, sf_dir):
    return stats.role_stats(utterances(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query("SELECT role, n FROM (SELECT role, count(*) AS n, min((chunk_id, dialogue_index)) AS f FROM u GROUP BY role ORDER BY n DESC, f LIMIT 10)")
def top_roles(spark, sf_dir):
    return stats.top_roles(utterances(spark, sf_dir))


@query("""SELECT count(*) AS total, count(DISTINCT role) AS roles, sum(l)::BIGINT AS chars, round(avg(l), 6) AS average, min(l) AS least, round(quantile_cont(l, 0.5), 6) AS p50,
round(CASE WHEN count(*) >= 10 THEN quantile_cont(l, 0.9) ELSE max(l) END, 6) AS p90, round(CASE WHEN count(*) >= 100 THEN quantile_cont(l, 0.99) ELSE max(l) END, 6) AS p99, max(l) AS most FROM (SELECT role, length(dialogue) AS l FROM u)""")
def length_summary(spark, sf_dir):
    found = stats.length_summary(utterances(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("average", "p50", "p90", "p99")})


@query("SELECT from_role, role AS to_role, count(*) AS n FROM (SELECT role, lag(role) OVER (PARTITION BY chunk_id ORDER BY dialogue_index) AS from_role FROM u) WHERE from_role IS NOT NULL GROUP BY ALL")
def role_transitions(spark, sf_dir):
    return stats.transitions(utterances(spark, sf_dir))


@query("SELECT chunk_id, count(*) AS dialogues, sum(length(dialogue))::BIGINT AS chars, min(length(dialogue)) AS least, max(length(dialogue)) AS most, round(avg(length(dialogue)), 6) AS average, count(DISTINCT role) AS roles FROM u GROUP BY chunk_id")
def chunk_stats(spark, sf_dir):
    return stats.chunk_stats(utterances(spark, sf_dir)).withColumns({"average": F.round("average", 6), "roles": F.size("roles").cast("long")})


@query("SELECT count(*) AS chunks, sum(n)::BIGINT AS dialogues, min(n) AS least, max(n) AS most, round(avg(n), 6) AS average, round(quantile_cont(n, 0.5), 6) AS p50, round(CASE WHEN count(*) >= 10 THEN quantile_cont(n, 0.9) ELSE max(n) END, 6) AS p90 FROM (SELECT count(*) AS n FROM u GROUP BY chunk_id)")
def chunk_density(spark, sf_dir):
    return stats.density(utterances(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("average", "p50", "p90")})


@query("SELECT chunk_id, count(*) AS dialogues FROM u GROUP BY chunk_id ORDER BY dialogues DESC, chunk_id LIMIT 5")
def densest_chunks(spark, sf_dir):
    return stats.densest(utterances(spark, sf_dir))


@query("SELECT chunk_id, dialogue_index, role, dialogue FROM u ORDER BY 1, 2")
def sort_utterances(spark, sf_dir):
    return stats.ordered(utterances(spark, sf_dir)).select("chunk_id", "dialogue_index", "role", "dialogue")


@query("SELECT chunk_id, dialogue_index, role, dialogue FROM u WHERE chunk_id IN (1, 2, 3)")
def filter_by_chunk(spark, sf_dir):
    return stats.of_chunks(utterances(spark, sf_dir), [1, 2, 3]).select("chunk_id", "dialogue_index", "role", "dialogue")


@query("SELECT chunk_id, dialogue_index, role, dialogue FROM u ORDER BY line_no LIMIT 8")
def preview_head(spark, sf_dir):
    return stats.head(utterances(spark, sf_dir), 8, "line_no").select("chunk_id", "dialogue_index", "role", "dialogue")


_CHAT_SQL = f"SELECT chunk_id, source_index, reply_index, m.pos AS pos, m.role AS role, m.content AS content FROM (SELECT *, unnest([{{{{'pos': 0::BIGINT, 'role': 'system', 'content': '{chat.DEFAULT_SYSTEM}'}}}}, {{{{'pos': 1::BIGINT, 'role': 'user', 'content': trim({{u}}, {WHITE_SQL})}}}}, {{{{'pos': 2::BIGINT, 'role': 'assistant', 'content': trim({{a}}, {WHITE_SQL})}}}}]) AS m FROM ({{rows}}))"


def _chat_sql(user: str, assistant: str, rows: str) -> str:
    return _CHAT_SQL.replace("{{", "{").replace("}}", "}").replace("{u}", user).replace("{a}", assistant).replace("{rows}", rows)


def _chat(spark, sf_dir, **settings):
    samples = chat.usable(_samples(spark, sf_dir, strict=True), dedupe=settings.pop("dedupe", False))
    keyed = chat.single_turn(samples, meta=True, **settings).select(F.col("meta.source.chunk_id").alias("chunk_id"), F.col("meta.source.dialogue_index").alias("source_index"), F.col("meta.reply.dialogue_index").alias("reply_index"), "messages")
    return chat.message_rows(keyed, "chunk_id", "source_index", "reply_index")


@query(_chat_sql("source_text", "reply_text", _pairs_sql(True, 0.8)))
def chat_single_turn(spark, sf_dir):
    return _chat(spark, sf_dir)


@query(_chat_sql("reply_text", "source_text", _pairs_sql(True, 0.8)))
def chat_single_turn_reversed(spark, sf_dir):
    return _chat(spark, sf_dir, reverse=True)


@query(_chat_sql("source_text", "reply_text", f"SELECT * FROM ({_pairs_sql(True, 0.8)}) QUALIFY row_number() OVER (PARTITION BY trim(source_text, {WHITE_SQL}), trim(reply_text, {WHITE_SQL}) ORDER BY chunk_id, source_index, reply_index) = 1"))
def chat_deduplicated(spark, sf_dir):
    return _chat(spark, sf_dir, dedupe=True)


_STITCH_SQL = f""", RECURSIVE_EDGES AS (
  SELECT *, least(from_role, to_role) AS role_a, greatest(from_role, to_role) AS role_b FROM ({_pairs_sql(True, 0.5)})
), e AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id, role_a, role_b, source_index ORDER BY reply_index) = 1 AS first_child FROM RECURSIVE_EDGES
), heads AS (
  SELECT x.* FROM e x WHERE NOT x.first_child OR NOT EXISTS (SELECT 1 FROM e y WHERE y.chunk_id = x.chunk_id AND y.role_a = x.role_a AND y.role_b = x.role_b AND y.reply_index = x.source_index)
), walk AS (
  SELECT chunk_id, role_a, role_b, source_index AS head_s, reply_index AS head_r, source_index, reply_index, 0 AS depth, from_role, to_role, source_text, reply_text FROM heads
  UNION ALL
  SELECT e.chunk_id, e.role_a, e.role_b, w.head_s, w.head_r, e.source_index, e.reply_index, w.depth + 1, e.from_role, e.to_role, e.source_text, e.reply_text
  FROM walk w JOIN e ON e.chunk_id = w.chunk_id AND e.role_a = w.role_a AND e.role_b = w.role_b AND e.source_index = w.reply_index AND e.first_child
)"""


@query("SELECT chunk_id, role_a, role_b, min(source_index) AS first_source, min(reply_index) AS first_reply, count(*) AS turns FROM walk GROUP BY chunk_id, role_a, role_b, head_s, head_r, depth // 3", UTTERANCES_SQL.replace("WITH base", "WITH RECURSIVE base") + _STITCH_SQL)
def chat_stitched_sessions(spark, sf_dir):
    samples = chat.usable(_samples(spark, sf_dir, strict=True, min_confidence=0.5))
    rows = chat.sessions(samples, 3).groupBy("chunk_id", "role_a", "role_b", "session")
    return rows.agg(F.min("source.dialogue_index").alias("first_source"), F.min("reply.dialogue_index").alias("first_reply"), F.count(F.lit(1)).alias("turns")).drop("session")


_MESSAGES_SQL = f"""SELECT chunk_id, role_a, role_b, session, pos::BIGINT AS pos, role, content FROM (
  SELECT *, dense_rank() OVER (PARTITION BY chunk_id, role_a, role_b ORDER BY s0, r0) - 1 AS session, row_number() OVER (PARTITION BY chunk_id, role_a, role_b, s0, r0 ORDER BY place, part) - 1 AS pos FROM (
    SELECT *, unnest(CASE WHEN place = 0 THEN [{{'part': 0, 'role': 'system', 'content': '{chat.DEFAULT_SYSTEM}'}}, {{'part': 1, 'role': 'user', 'content': source_text}}, {{'part': 2, 'role': 'assistant', 'content': reply_text}}]
      WHEN from_role = t0 THEN [{{'part': 0, 'role': 'user', 'content': reply_text}}] WHEN from_role = f0 THEN [{{'part': 0, 'role': 'assistant', 'content': reply_text}}] ELSE [] END, recursive := true)
    FROM (SELECT chunk_id, role_a, role_b, from_role, depth % 3 AS place, trim(source_text, {WHITE_SQL}) AS source_text, trim(reply_text, {WHITE_SQL}) AS reply_text,
      first(from_role) OVER c AS f0, first(to_role) OVER c AS t0, first(source_index) OVER c AS s0, first(reply_index) OVER c AS r0
      FROM walk WINDOW c AS (PARTITION BY chunk_id, role_a, role_b, head_s, head_r, depth // 3 ORDER BY depth))))"""


@query(_MESSAGES_SQL, UTTERANCES_SQL.replace("WITH base", "WITH RECURSIVE base") + _STITCH_SQL)
def chat_stitched_messages(spark, sf_dir):
    samples = chat.usable(_samples(spark, sf_dir, strict=True, min_confidence=0.5))
    return chat.message_rows(chat.stitched(samples, 3), "chunk_id", "role_a", "role_b", "session")


@query("SELECT chunk_id, min(source_index) AS first_source, count(*) AS turns FROM walk GROUP BY chunk_id, role_a, role_b, head_s, head_r, depth // 3", UTTERANCES_SQL.replace("WITH base", "WITH RECURSIVE base") + _STITCH_SQL)
def sql_stitched_sessions(spark, sf_dir):
    """Pairing, buckets and sessions in Spark SQL alone: a self-join on reply links, and a table function over each bucket's samples in order."""
    surface.register(spark)
    surface.views(utterances=utterances(spark, sf_dir))
    return spark.sql("""
        WITH samples AS (
          SELECT c.chunk_id AS bucket, p.dialogue_index AS s, c.dialogue_index AS r, c.chunk_id AS r_chunk, p.role AS s_role, c.role AS r_role, least(p.role, c.role) AS role_a, greatest(p.role, c.role) AS role_b
          FROM convoflow_utterances c JOIN convoflow_utterances p ON p.chunk_id = c.reply.target_chunk_id AND p.dialogue_index = c.reply.target_index
          WHERE c.reply.confidence >= 0.5 AND c.reply.target_role = p.role AND p.role <> c.role AND trim(p.dialogue) <> '' AND trim(c.dialogue) <> ''
        )
        SELECT t.chunk_id, min(t.s) AS first_source, count(*) AS turns
        FROM stitch_samples(TABLE(SELECT bucket AS chunk_id, role_a, role_b, s, r, r_chunk, s_role, r_role FROM samples) PARTITION BY (chunk_id, role_a, role_b) ORDER BY (s, r, r_chunk, s_role, r_role), 3) t
        GROUP BY t.chunk_id, t.role_a, t.role_b, t.session""")


@query(_MESSAGES_SQL, UTTERANCES_SQL.replace("WITH base", "WITH RECURSIVE base") + _STITCH_SQL)
def chat_messages_by_links(spark, sf_dir):
    """The same messages where no bucket is gathered in one row: sessions are found by pointer doubling."""
    samples = chat.usable(_samples(spark, sf_dir, strict=True, min_confidence=0.5))
    return chat.message_rows(chat.stitched(samples, 3, bucket_rows=0), "chunk_id", "role_a", "role_b", "session")


_LINES_SQL = rf"SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x, {WHITE_SQL})), lambda x: x <> '') AS ls FROM documents)"


@query(_LINES_SQL, None)
def clean_lines(spark, sf_dir):
    return segment.clean_lines(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, line_no, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, line_no, list_filter(string_split(regexp_replace(line, '([。！？?!])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM ({_LINES_SQL}))", None)
def sentence_split(spark, sf_dir):
    return segment.split_sentences(segment.clean_lines(table(spark, sf_dir, "documents")))


#: Prefix sums, range lookups and pointers, with the pointers followed one by one; lines above the limit are packed by sentences.
_SEGMENT_SQL = f"""WITH RECURSIVE l AS (SELECT *, length(line) AS s FROM ({_LINES_SQL})
), p AS (SELECT *, sum(s) OVER w - s AS p, sum(s + 1) OVER w - s - 1 AS q, coalesce(lag(s) OVER w > 1000, true) AND s <= 1000 AS begins, count(*) OVER (PARTITION BY doc_id) AS n FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), o AS (SELECT a.doc_id, a.line_no, any_value(a.p) - min(b.p) AS cover, min(b.line_no) AS first FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.line_no <= a.line_no AND b.p >= a.p - 100 WHERE a.s <= 1000 GROUP BY a.doc_id, a.line_no
), f AS (SELECT p.*, CASE WHEN cover + s + 1 <= 1000 THEN cover ELSE 0 END AS cover, CASE WHEN cover + s + 1 <= 1000 THEN first ELSE p.line_no END AS first FROM p JOIN o ON o.doc_id = p.doc_id AND o.line_no = p.line_no
), e AS (SELECT a.doc_id, a.line_no, any_value(a.first) AS first, any_value(a.begins) AS begins, coalesce(min(b.line_no), any_value(a.n)) AS until FROM f a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.line_no > a.line_no AND a.cover + b.q + b.s + 1 - a.q > 1000 GROUP BY a.doc_id, a.line_no
), c AS (SELECT * FROM e WHERE begins UNION SELECT e.* FROM c JOIN e ON e.doc_id = c.doc_id AND e.line_no = c.until
), t AS (SELECT c.doc_id, c.line_no, 0 AS part, string_agg(l.line, chr(10) ORDER BY l.line_no) AS chunk_text FROM c JOIN l ON l.doc_id = c.doc_id AND l.line_no >= c.first AND l.line_no < c.until GROUP BY c.doc_id, c.line_no
), z AS (SELECT doc_id, line_no, string_split(list_reduce(list_filter(string_split(regexp_replace(line, '([。！？?!])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda a, x: a || CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) <= 1000 THEN '' ELSE chr(1) END || x), chr(1)) AS ps FROM l WHERE s > 1000
), u AS (SELECT * FROM t UNION ALL SELECT doc_id, line_no, unnest(range(len(ps))), unnest(ps) FROM z)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS chunk_id, chunk_text FROM u"""


@query(_SEGMENT_SQL, None)
def segment_chunks(spark, sf_dir):
    return segment.segment(table(spark, sf_dir, "documents"))


@query(_SEGMENT_SQL, None)
def segment_chunks_by_rows(spark, sf_dir):
    """The same chunks from rows of lines, by prefix sums and pointer jumping."""
    return cuts.segment_rows(table(spark, sf_dir, "documents"))


@query(_SEGMENT_SQL, None)
def sql_segment_chunks(spark, sf_dir):
    """The same chunks in Spark SQL: a table function over each document's lines in order."""
    surface.register(spark)
    surface.views(docs=table(spark, sf_dir, "documents"))
    return spark.sql("SELECT doc_id, chunk_id, chunk_text FROM segment_lines(TABLE(SELECT doc_id, line_no, line FROM convoflow_lines) PARTITION BY (doc_id) ORDER BY (line_no), 1000, 100)")


@query()
def segment_chunks_by_tokens(spark, sf_dir):
    """Chunks of a given tokenizer's tokens; no SQL knows them, so the tests hold them against the fold."""
    return cuts.segment_rows(table(spark, sf_dir, "documents"), segment.token_counter(segment.tokenizer_file()), 512, 64)


def _responses(spark, sf_dir):
    """A model's answer for each conversation, wrapped in one of several ways; every seventh holds no list."""
    rows = utterances(spark, sf_dir)
    item = F.struct(F.col("dialogue_index").alias("at"), F.struct("role", "dialogue", F.struct("reply.target_index", "reply.target_role", "reply.confidence").alias("reply")).alias("item"))
    body = rows.groupBy("chunk_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])).alias("body"))
    way = F.pmod("chunk_id", F.lit(7))
    wrapped = (
        F.when(way == 0, F.col("body"))
        .when(way == 1, F.concat(F.lit('{"script": '), F.col("body"), F.lit("}")))
        .when(way == 2, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```")))
        .when(way == 3, F.concat(F.lit("<think>[1]</think>\n"), F.col("body")))
        .when(way == 4, F.concat(F.lit("Here [not json] it is: "), F.col("body"), F.lit(" done.")))
        .when(way == 5, F.concat(F.repeat(F.lit("["), F.lit(3000)), F.lit("no end, then "), F.col("body")))
        .otherwise(F.lit('{"error": "no list"}'))
    )
    return body.select("chunk_id", wrapped.alias("response"))


@query("SELECT chunk_id, dialogue_index, role, dialogue, CASE WHEN t_index IS NOT NULL AND dialogue_index - t_index <= 6 AND coalesce(confidence, 1.0) >= 0.65 THEN t_index END AS target_index FROM u WHERE chunk_id % 7 <> 6")
def parsed_responses(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("response", parse.strip_reasoning(F.col("response")))
    found = parse.utterances(parse.script(rows))
    return found.select("chunk_id", "dialogue_index", "role", "dialogue", F.col("reply.target_index").alias("target_index"))


@query("SELECT DISTINCT chunk_id, CASE WHEN chunk_id % 7 = 6 THEN 'failed' ELSE 'ok' END AS parse_status FROM u")
def parse_status(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("response", parse.strip_reasoning(F.col("response")))
    return parse.script(rows).select("chunk_id", "parse_status")


@query("SELECT chunk_id, dialogue_index, t_index IS NOT NULL AND dialogue_index - t_index <= 6 AND coalesce(confidence, 0) >= 0.65 AS kept FROM u")
def reply_links_kept(spark, sf_dir):
    kept = parse.clean_reply(F.col("dialogue_index"), F.col("reply.target_index"), F.col("reply.confidence"))
    return utterances(spark, sf_dir).select("chunk_id", "dialogue_index", kept.alias("kept"))


@query(ERRORS_SQL.lstrip(", "), UTTERANCES_SQL + ",")
def validation_errors(spark, sf_dir):
    rows = raw_lines(spark, sf_dir).withColumn("v", F.try_parse_json("value"))
    return validate.errors(rows)


@query("SELECT line_no, chunk_id, dialogue_index, 'E_CONFIDENCE' AS code FROM u WHERE t_index IS NOT NULL AND confidence IS NULL")
def validation_of_clean_rows(spark, sf_dir):
    link = F.struct("reply.target_index", "reply.target_role", "reply.confidence")
    rows = utterances(spark, sf_dir).select("line_no", F.struct("chunk_id", "dialogue_index", "role", "dialogue", F.when(F.col("reply").isNotNull(), link).alias("reply")).alias("row"))
    return validate.errors(rows.select("line_no", F.try_parse_json(F.to_json("row")).alias("v")))


@query("SELECT DISTINCT chunk_id FROM u WHERE chunk_id % 3 <> 0")
def resume_remaining(spark, sf_dir):
    ids = utterances(spark, sf_dir).select("chunk_id").distinct()
    return resume.remaining(ids, ids.where("chunk_id % 3 = 0"))


@query("SELECT chunk_id, dialogue_index FROM u WHERE chunk_id % 3 = 0")
def resume_kept_output(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    return resume.kept_output(rows, rows.where("chunk_id % 3 = 0")).select("chunk_id", "dialogue_index")


@query("SELECT min(chunk_id + 1) AS chunk_id FROM (SELECT DISTINCT chunk_id FROM u WHERE chunk_id % 7 <> 6 UNION ALL SELECT -1) WHERE chunk_id + 1 NOT IN (SELECT chunk_id FROM u WHERE chunk_id % 7 <> 6)")
def first_missing_chunk(spark, sf_dir):
    return resume.first_missing(utterances(spark, sf_dir).where("chunk_id % 7 <> 6"))


@query("SELECT DISTINCT chunk_id FROM u WHERE chunk_id <> (SELECT chunk_id FROM u ORDER BY line_no DESC LIMIT 1)")
def processed_chunks(spark, sf_dir):
    return resume.processed_ids(utterances(spark, sf_dir))


@query(r"SELECT DISTINCT from_role, to_role, 'pair_' || regexp_replace(from_role, '\s+', '_', 'g') || '__to__' || regexp_replace(to_role, '\s+', '_', 'g') || '.jsonl' AS name FROM (" + _pairs_sql(True, 0.8) + ")")
def pair_file_names(spark, sf_dir):
    found = pairs.pair_counts(_samples(spark, sf_dir, strict=True))
    return found.select("from_role", "to_role", text.pair_file_name(F.col("from_role"), F.col("to_role")).alias("name"))


# ---- documents that number their chunks alike ---------------------------------------------------------------------------


def _document_samples(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return pairs.build_pairs(of_documents(spark, sf_dir), **settings)


def _document_sql(sql: str, base: str = DOCUMENTS_SQL) -> dict:
    return {"sql": by_document(sql), "base": base}


@query(**_document_sql(_pairs_sql(True, 0.8)))
def document_pairs_strict(spark, sf_dir):
    found = _document_samples(spark, sf_dir, strict=True)
    return _flat(found, "doc_id")


@query(**_document_sql(_pairs_sql(False, None)))
def document_pairs_relaxed(spark, sf_dir):
    return _flat(_document_samples(spark, sf_dir, min_confidence=None), "doc_id")


@query("SELECT DISTINCT a.doc_id, a.role AS from_role, 'assistant' AS to_role FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.role = 'assistant' WHERE a.role <> 'assistant'", DOCUMENTS_SQL)
def document_pairs_wildcard(spark, sf_dir):
    return pairs.wanted_pairs(of_documents(spark, sf_dir), ["ALL,assistant"])


@query(**_document_sql(_MESSAGES_SQL, DOCUMENTS_SQL.replace("WITH base", "WITH RECURSIVE base") + by_document(_STITCH_SQL)))
def document_chat_messages(spark, sf_dir):
    samples = chat.usable(_document_samples(spark, sf_dir, strict=True, min_confidence=0.5))
    return chat.message_rows(chat.stitched(samples, 3), "doc_id", "chunk_id", "role_a", "role_b", "session")


@query(**_document_sql(ERRORS_SQL.lstrip(", "), DOCUMENTS_SQL + ","))
def document_validation_errors(spark, sf_dir):
    rows = raw_lines(spark, sf_dir, of_documents(spark, sf_dir)).withColumn("v", F.try_parse_json("value"))
    return validate.errors(rows)


@query("""SELECT doc_id, line_no, NULL::BIGINT AS chunk_id, NULL::BIGINT AS dialogue_index, 'E_JSON' AS code FROM u WHERE doc_id % 4 = 3
UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, 'E_EMPTY' FROM u WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, line_no, chunk_id, dialogue_index, CASE WHEN line_no % 5 = 2 THEN 'E_TARGET_ROLE' ELSE 'E_RANGE' END FROM u WHERE doc_id % 4 <> 3 AND t_index IS NOT NULL AND (line_no % 5 = 2 OR line_no % 5 = 1 AND chunk_id > 0)""", documents_sql(5))
def document_validation_faults(spark, sf_dir):
    """Documents without a usable line, targets beyond the size of an earlier chunk, target roles that are no text."""
    rows = of_documents(spark, sf_dir, 5).withColumn("f", F.pmod("line_no", F.lit(5)))
    index, chunk = F.col("reply.target_index"), F.col("chunk_id") - 1
    beyond = F.format_string('{"target_index": 99, "target_chunk_id": %d, "confidence": 0.9}', chunk)
    number = F.format_string('{"target_index": %d, "target_role": 5, "confidence": 0.9}', index)
    link = F.when(index.isNull(), F.lit("null")).when((F.col("f") == 1) & (chunk >= 0), beyond).when(F.col("f") == 2, number).otherwise(F.lit("null"))
    line = F.format_string('{"chunk_id": %d, "dialogue_index": %d, "role": "x", "dialogue": "y", "reply": %s}', "chunk_id", "dialogue_index", link)
    value = F.when(F.col("doc_id") % 4 == 3, F.lit('{"chunk_id":')).otherwise(line)
    return validate.errors(rows.select("doc_id", "line_no", F.try_parse_json(value).alias("v")))


@query("SELECT doc_id, chunk_id, count(*) AS dialogues, sum(length(dialogue))::BIGINT AS chars, min(length(dialogue)) AS least, max(length(dialogue)) AS most, round(avg(length(dialogue)), 6) AS average, count(DISTINCT role) AS roles FROM u GROUP BY doc_id, chunk_id", DOCUMENTS_SQL)
def document_chunk_stats(spark, sf_dir):
    return stats.chunk_stats(of_documents(spark, sf_dir)).withColumns({"average": F.round("average", 6), "roles": F.size("roles").cast("long")})


@query("SELECT doc_id, from_role, role AS to_role, count(*) AS n FROM (SELECT doc_id, role, lag(role) OVER (PARTITION BY doc_id, chunk_id ORDER BY dialogue_index) AS from_role FROM u) WHERE from_role IS NOT NULL GROUP BY ALL", DOCUMENTS_SQL)
def document_role_transitions(spark, sf_dir):
    return stats.transitions(of_documents(spark, sf_dir), per=["doc_id"])


@query("SELECT doc_id, role, n FROM (SELECT doc_id, role, count(*) AS n, min((chunk_id, dialogue_index)) AS f FROM u GROUP BY doc_id, role) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 2", DOCUMENTS_SQL)
def document_top_roles(spark, sf_dir):
    return stats.top_roles(of_documents(spark, sf_dir), 2, ["doc_id"])


@query("SELECT doc_id, chunk_id FROM u GROUP BY doc_id, chunk_id QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY max(line_no) DESC) > 1", DOCUMENTS_SQL)
def document_processed_chunks(spark, sf_dir):
    return resume.processed_ids(of_documents(spark, sf_dir))


@query("SELECT d.doc_id, min(d.chunk_id)::BIGINT AS chunk_id FROM (SELECT doc_id, chunk_id + 1 AS chunk_id FROM u WHERE line_no % 7 <> 6 UNION SELECT doc_id, 0 FROM u WHERE line_no % 7 <> 6) d ANTI JOIN (SELECT doc_id, chunk_id FROM u WHERE line_no % 7 <> 6) x ON x.doc_id = d.doc_id AND x.chunk_id = d.chunk_id GROUP BY d.doc_id", DOCUMENTS_SQL)
def document_first_missing_chunk(spark, sf_dir):
    return resume.first_missing(of_documents(spark, sf_dir).where("line_no % 7 <> 6"))


# ---- schemas and numbering ----------------------------------------------------------------------------------------------

SCHEMA = Schema("Who speaks, and how?", (Attribute("tone", "string", "one word", optional=True), Attribute("words", "integer")))


def _with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as items with two more attributes, some of them of a wrong type or missing."""
    rows = utterances(spark, sf_dir).withColumn("f", F.pmod(F.col("line_no"), F.lit(9)))
    tone = F.when(F.col("f") == 0, F.lit("7")).when(F.col("f") == 1, F.lit("null")).when(F.col("f") == 2, F.lit('" dry "')).otherwise(F.lit('"warm"'))
    words = F.when(F.col("f") == 3, F.lit('"many"')).when(F.col("f") == 4, F.lit("1.5")).when(F.col("f") == 5, F.lit("null")).otherwise(F.size(F.split("dialogue", " ")).cast("string"))
    core = F.to_json(F.struct("chunk_id", "dialogue_index", "role", "dialogue", F.struct("reply.target_index", "reply.target_role", F.coalesce("reply.confidence", F.lit(0.9)).alias("confidence")).alias("reply")))
    bare = F.to_json(F.struct("chunk_id", "dialogue_index", "role", "dialogue"))
    whole = F.when(F.col("reply").isNull(), bare).otherwise(core)
    item = F.concat(F.substring(whole, 1, F.length(whole) - 1), F.lit(', "tone": '), tone, F.when(F.col("f") == 6, F.lit("")).otherwise(F.concat(F.lit(', "words": '), words)), F.lit("}"))
    return rows.select("chunk_id", "dialogue_index", "line_no", item.alias("item"))


@query("""SELECT chunk_id, dialogue_index, role, dialogue, CASE WHEN line_no % 9 = 2 THEN 'dry' WHEN line_no % 9 > 1 THEN 'warm' END AS tone,
CASE WHEN line_no % 9 NOT IN (3, 4, 5, 6) THEN len(string_split(dialogue, ' ')) END::BIGINT AS words FROM u""")
def schema_responses(spark, sf_dir):
    items = _with_attributes(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("dialogue_index", "item"))).alias("items"))
    responses = items.select("chunk_id", F.concat(F.lit('{"script": ['), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]}")).alias("response"))
    return parse.utterances(parse.script(responses), schema=SCHEMA).drop("reply")


@query("""SELECT line_no, chunk_id, dialogue_index, 'E_ATTRIBUTE:' || CASE WHEN line_no % 9 = 0 THEN 'tone' ELSE 'words' END AS code FROM u WHERE line_no % 9 IN (0, 3, 4, 5, 6)
UNION ALL SELECT c.line_no, c.chunk_id, c.dialogue_index, 'E_TARGET_MISSING' FROM u c JOIN u p ON p.chunk_id = c.chunk_id AND p.dialogue_index = c.t_index WHERE c.line_no % 9 NOT IN (0, 3, 4, 5, 6) AND p.line_no % 9 IN (0, 3, 4, 5, 6)
UNION ALL SELECT line_no, chunk_id, dialogue_index, 'E_GAP' FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY dialogue_index) - 1 AS place FROM u WHERE line_no % 9 NOT IN (0, 3, 4, 5, 6)) WHERE place <> dialogue_index""")
def schema_errors(spark, sf_dir):
    rows = _with_attributes(spark, sf_dir).select("line_no", F.try_parse_json("item").alias("v"))
    return validate.errors(rows, schema=SCHEMA).where("code <> 'E_EMPTY'")


@query("""SELECT c.chunk_id, k.place AS dialogue_index, c.role, t.place AS target_index FROM u c
JOIN (SELECT chunk_id, dialogue_index, row_number() OVER (PARTITION BY chunk_id ORDER BY dialogue_index) - 1 AS place FROM u WHERE line_no % 4 <> 1) k ON k.chunk_id = c.chunk_id AND k.dialogue_index = c.dialogue_index
LEFT JOIN (SELECT chunk_id, dialogue_index, row_number() OVER (PARTITION BY chunk_id ORDER BY dialogue_index) - 1 AS place FROM u WHERE line_no % 4 <> 1) t ON t.chunk_id = c.chunk_id AND t.dialogue_index = c.t_index AND coalesce(c.confidence, 1.0) >= 0.65 AND k.place - t.place <= 6""")
def remapped_replies(spark, sf_dir):
    """Every fourth item has no text and is left out; links keep to the numbers that the model has given."""
    said = F.when(F.pmod("line_no", F.lit(4)) == 1, F.lit(" ")).otherwise(F.col("dialogue"))
    item = F.struct("dialogue_index", F.struct("role", said.alias("dialogue"), F.struct("reply.target_index", "reply.target_role", "reply.confidence").alias("reply")).alias("item"))
    rows = utterances(spark, sf_dir).groupBy("chunk_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])).alias("response"))
    found = parse.utterances(parse.script(rows), remap=True)
    return found.select("chunk_id", "dialogue_index", "role", F.col("reply.target_index").alias("target_index"))
