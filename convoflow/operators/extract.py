"""The model map: chunks to responses. Responses are kept before they are parsed, so that a run can be replayed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys of an item that a model is asked for.
ITEM_KEYS = [("role", "string"), ("dialogue", "string"), ("reply", "{target_index: number, target_role: string, confidence: number} | null")]


def prompt(task: str, window: int = 6, keys=tuple(ITEM_KEYS), example: str | None = None) -> str:
    """The system prompt: the task, the wanted JSON, the reply rules and an example."""
    wanted = "\n".join(f"    {name}: {type_}," for name, type_ in keys)
    rules = f"Reply targets are earlier items of the same list, at most {window} before; leave reply null where no earlier item is answered."
    return "\n\n".join([task, "Return a JSON list of items:\n[\n  {\n" + wanted + "\n  }\n]", rules, *([f"Example:\n{example}"] if example else [])])


def replay(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that an earlier run has stored: chunks without one have failed."""
    status = F.when(F.col("response").isNull(), F.lit("failed")).otherwise(F.lit("ok"))
    return chunks.join(responses.select("doc_id", "chunk_id", "response"), ["doc_id", "chunk_id"], "left").withColumn("status", status)


def extract(chunks: DataFrame, call: Callable[[str], str], parallelism: int = 8, retries: int = 3, delay: float = 2.0, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """chunks (keys, chunk_text) plus response, status and error; call: a function from a chunk to a model's response.

    Calls in flight are the partitions; each is tried again after a growing pause, and a chunk that keeps failing is a row that
    says so, not a failed job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            responses, errors = [], []
            for text in batch.column("chunk_text").to_pylist():
                response, error = None, None
                for attempt in range(retries):
                    try:
                        response, error = call(text), None
                        break
                    except Exception as failed:  # noqa: BLE001  what a backend raises is its own
                        error = str(failed)
                        if attempt + 1 < retries:
                            time.sleep(delay * (attempt + 1))
                responses.append(response)
                errors.append(error)
            status = ["ok" if e is None else "failed" for e in errors]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(responses, pa.string()), pa.array(status), pa.array(errors, pa.string())], [*batch.schema.names, "response", "status", "error"])

    rows = chunks.select(*keys, "chunk_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(parallelism).mapInArrow(run, f"{schema}, response string, status string, error string")


def response_text(payload: F.Column) -> F.Column:
    """The answer in a raw reply of a chat or responses endpoint, stripped."""
    v = F.try_parse_json(payload)
    get = lambda of, path, type_="string": F.try_variant_get(of, path, type_)
    contents = F.transform(get(v, "$.output", "array<variant>"), lambda item: F.coalesce(get(item, "$.content", "array<variant>"), F.array().cast("array<variant>")))
    # Reasoning and tool items have no text, and a message may begin with other parts.
    parts = F.filter(F.transform(F.flatten(contents), lambda part: get(part, "$.text")), lambda text: text != "")
    return F.trim(F.coalesce(F.nullif(get(v, "$.output_text"), F.lit("")), F.get(parts, F.lit(0)), get(v, "$.choices[0].message.content"), get(v, "$.choices[0].text")))


def failed(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'failed'")


def speed(processed: int, total: int, elapsed: float) -> dict[str, float | None]:
    """Chunks a second and seconds left."""
    rate = processed / elapsed if elapsed > 0 else 0.0
    return {"speed_cps": rate, "eta_sec": (total - processed) / rate if rate > 0 else None}
