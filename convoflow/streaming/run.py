"""One resumable run: texts to chunks, in waves to a model's responses, to numbered utterances.

A chunk's content is a hash of the prompt and its text, and responses are kept by content: equal chunks are asked for once, a
text or prompt that has changed is asked for anew, and what was said about the old one is no longer returned. Contents without a
response are queued in files of one wave each. A stream takes the waves in turn and writes each one's responses as a whole, under
a name made of the stream and the batch; its checkpoint moves on after that. So a run that breaks keeps all waves before, a wave
that is replayed after its responses were written is not asked for again, and the next run goes on with what is queued.

What lies in a run's folder:
    documents, chunks    the documents of each run and their chunks; of a document the latest run counts
    queue, checkpoint    contents to ask for, and how far the stream has come
    responses            content, response, status, error, by wave
    progress             a row for each wave
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoflow.config import Settings
from convoflow.operators import extract, parse, segment
from convoflow.operators.schema import Schema
from convoflow.streaming import resume

_KEY = ["doc_id", "chunk_id"]
_SCHEMAS = {
    "documents": "doc_id long, run long",
    "chunks": "doc_id long, chunk_id long, chunk_text string, content string, run long",
    "queue": "content string, prompt string, chunk_text string",
    "responses": "content string, response string, status string, error string, run long, batch long, wave string",
    "progress": "run long, batch long, processed long, total long, failed long, elapsed double, speed_cps double, eta_sec double",
}


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    system, path = _path(spark, name)
    return system.exists(path)


def _held(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], _SCHEMAS[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}")


def _add(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/{name}")


def content(prompt: str, text: str = "chunk_text") -> F.Column:
    """What a response is an answer to, as a hash of the prompt and a chunk."""
    return F.sha2(F.concat_ws("\x1f", F.sha2(F.lit(prompt), 256), F.col(text)), 256)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, chunk_id, chunk_text, content: the chunks of every document as the latest run that held it has cut it."""
    latest = _held(spark, folder, "documents").groupBy("doc_id").agg(F.max("run").alias("run"))
    held = _held(spark, folder, "chunks")
    of, same = latest.select(F.col("doc_id").alias("_doc"), F.col("run").alias("_run")), held["doc_id"].eqNullSafe(F.col("_doc")) & (held["run"] == F.col("_run"))
    return held.join(of, same, "left_semi").drop("run")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """content, response, status, error of the last attempt at each content."""
    last = F.max_by(F.struct("response", "status", "error"), F.struct("run", "batch")).alias("last")
    return _held(spark, folder, "responses").groupBy("content").agg(last).select("content", "last.*")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks (doc_id, chunk_id, chunk_text) with response, status and error; those that were never asked for are left out."""
    return chunks(spark, folder).join(answers(spark, folder), "content").drop("content")


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, chunk_id of every chunk that has its response."""
    return resume.finish(responses(spark, folder)).select(*_KEY)


def utterances(spark: SparkSession, folder: str, settings: Settings = Settings(), keep_text: bool = False, schema: Schema | None = None) -> DataFrame:
    """The utterances of completed chunks, as far as runs have come, read by these settings and this schema; keep_text: with their chunk_text."""
    good = resume.finish(responses(spark, folder))
    read = parse.script(good.withColumn("response", parse.strip_reasoning(F.col("response"))), settings.fail_on_parse_error)
    return parse.utterances(read, (*_KEY, *(["chunk_text"] if keep_text else [])), settings.reply_window, settings.reply_confidence, schema, settings.remap_targets)


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose last attempt has failed, each once, however often it was tried: they hold their place with no utterances."""
    return extract.failed(responses(spark, folder))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each wave: chunks that are done and failed so far in its run, of how many, chunks a second and seconds left."""
    return _held(spark, folder, "progress")


def _stream_name(spark: SparkSession, folder: str) -> str:
    """The stream's own name: that of its checkpoint, so that waves of another checkpoint are other waves."""
    system, path = _path(spark, f"{folder}/checkpoint")
    found = sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []
    return found[-1] if found else uuid.uuid4().hex


def drain(spark: SparkSession, folder: str, call: Callable[[str], str], prompt: str, settings: Settings, run_no: int, total: int) -> None:
    """Takes all waves that are queued and not done. Rows that were queued under another prompt are passed over."""
    if not _exists(spark, f"{folder}/queue"):
        return
    stream, began, count = _stream_name(spark, folder), time.monotonic(), {"processed": 0, "failed": 0}

    def commit(batch: DataFrame, number: int) -> None:
        own, wave = batch.sparkSession, f"{stream}-{number:09d}"
        place = f"{folder}/responses/wave={wave}"
        if not _exists(own, f"{place}/_SUCCESS"):
            asked = batch.where(F.col("prompt") == prompt).select("content", "chunk_text")
            taken = extract.extract(asked, call, settings.parallelism, settings.max_retries, settings.retry_delay, ("content",))
            taken.drop("chunk_text").withColumns({"run": F.lit(run_no).cast("long"), "batch": F.lit(number).cast("long")}).write.mode("overwrite").parquet(place)
        done = own.read.schema(_SCHEMAS["responses"]).parquet(place).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("bad")).first()
        count["processed"] += done["n"]
        count["failed"] += done["bad"]
        elapsed = time.monotonic() - began
        speed = extract.speed(count["processed"], max(total, count["processed"]), elapsed)
        row = (run_no, number, count["processed"], max(total, count["processed"]), count["failed"], elapsed, speed["speed_cps"], speed["eta_sec"])
        own.createDataFrame([row], _SCHEMAS["progress"]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/wave={wave}")

    rows = spark.readStream.schema(_SCHEMAS["queue"]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queue")
    query = rows.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint/{stream}").trigger(availableNow=True).start()
    query.awaitTermination()


def _enqueue(missing: DataFrame, folder: str, prompt: str, wave_chunks: int) -> int:
    """Queues contents in files of about wave_chunks rows, in the order of their chunks; returns how many there are."""
    n = missing.count()
    if n:
        waves = -(-n // wave_chunks)
        rows = missing.repartitionByRange(waves, "first", "content").select("content", F.lit(prompt).alias("prompt"), "chunk_text")
        rows.write.mode("append").option("maxRecordsPerFile", wave_chunks).parquet(f"{folder}/queue")
    return n


def run(docs: DataFrame, call: Callable[[str], str], folder: str, settings: Settings = Settings(), tokens: segment.Tokens = len, check: bool = True, prompt: str = "", keep_text: bool = False, schema: Schema | None = None) -> DataFrame:
    """docs (doc_id, text): asks for every content that has no response; returns all utterances. check: an error at the end if a chunk has failed.

    prompt: whatever besides the chunk decides a response (the system prompt, such as `Schema.prompt` makes, the model, the
    temperature), as one text; where it is empty, a schema's prompt. schema: attributes that utterances have besides. A
    response that holds no list fails the run if the settings say so, and else is a chunk without utterances, as in parsing.
    Null texts have no chunks, and a document whose text has become null loses those that it had; rows that repeat an id are one
    document's chunks twice, so ids should be distinct. A null id is an id like any other.
    """
    prompt = prompt or (schema.prompt(settings.reply_window) if schema else "")
    spark, fingerprint = docs.sparkSession, uuid.uuid5(uuid.NAMESPACE_OID, prompt).hex
    number = (_held(spark, folder, "documents").agg(F.max("run")).first()[0] or 0) + 1
    cut = segment.segment(docs, tokens, settings.max_tokens, settings.cover_tokens)
    _add(cut.select(F.col("doc_id").cast("long"), "chunk_id", "chunk_text", content(prompt).alias("content"), F.lit(number).cast("long").alias("run")), folder, "chunks")
    _add(docs.select(F.col("doc_id").cast("long")).distinct().withColumn("run", F.lit(number).cast("long")), folder, "documents")
    drain(spark, folder, call, fingerprint, settings, number, 0)
    mine = chunks(spark, folder).join(_held(spark, folder, "documents").where(F.col("run") == number).select(F.col("doc_id").alias("_doc")), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    known = resume.finish(answers(spark, folder)).select("content")
    missing = mine.groupBy("content").agg(F.min(F.struct("doc_id", "chunk_id")).alias("first"), F.first("chunk_text").alias("chunk_text")).join(known, "content", "left_anti")
    if total := _enqueue(missing, folder, fingerprint, settings.wave_chunks):
        drain(spark, folder, call, fingerprint, settings, number, total)
    if settings.fail_on_parse_error:
        parse.script(resume.finish(responses(spark, folder)), True).select("parse_status").write.format("noop").mode("overwrite").save()
    if check:
        resume.assert_complete(responses(spark, folder))
    return utterances(spark, folder, settings, keep_text, schema)
