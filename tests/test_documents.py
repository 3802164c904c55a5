"""Several documents in one table: keys, and runs from texts to chat records."""

from __future__ import annotations

import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, utterance

from convoflow import keys
from convoflow import sql as surface
from convoflow.config import Settings, platform
from convoflow.operators import chat, cuts, pairs, parse, segment, stats, validate
from convoflow.operators.schema import Schema
from convoflow.shared import BATCH_BYTES
from convoflow.sources import ordered
from convoflow.streaming import resume, run

KEYED = "doc_id long, " + SCHEMA


def two(spark):
    """Two documents, each with chunk 0 of a question and its reply; the second has a third turn; a null document with one line."""
    rows = [(d, 0, i, "AB"[i % 2], f"{d}-{i}", (i - 1, 0, "AB"[(i - 1) % 2], 0.9) if i else None, i) for d, n in ((1, 2), (2, 3), (None, 1)) for i in range(n)]
    return spark.createDataFrame(rows, KEYED)


def test_links_stay_within_a_document(spark):
    found = pairs.build_pairs(two(spark), strict=True)
    assert found.columns == ["doc_id", "source", "reply", "pair", "confidence"]
    assert sorted((r["doc_id"], r["source"]["text"], r["reply"]["text"]) for r in found.collect()) == [(1, "1-0", "1-1"), (2, "2-0", "2-1"), (2, "2-1", "2-2")]
    for d in (1, 2):  # each alone gives what it gives among the others
        alone = pairs.build_pairs(two(spark).where(F.col("doc_id") == d).drop("doc_id"), strict=True)
        assert sorted(map(str, alone.collect())) == sorted(map(str, found.where(F.col("doc_id") == d).drop("doc_id").collect()))
    assert [(r["from_role"], r["n"]) for r in pairs.pair_counts(found, ["doc_id"]).where("doc_id = 2").orderBy("from_role").collect()] == [("A", 1), ("B", 1)]
    wanted = pairs.wanted_pairs(two(spark), ["ALL,A", "A,Z"])
    assert sorted(map(str, ((r["doc_id"], r["from_role"], r["to_role"]) for r in wanted.collect()))) == sorted(map(str, [(1, "B", "A"), (2, "B", "A"), (1, "A", "Z"), (2, "A", "Z"), (None, "A", "Z")]))
    assert [r["reply"]["text"] for r in pairs.build_pairs(two(spark), wanted).collect()] == ["2-2"]
    with pytest.raises(ValueError, match="no column"):
        pairs.build_pairs(two(spark), doc=["book"])


def test_roles_of_another_document_stand_in_for_nothing(spark):
    rows = [(1, 0, 0, "A", "x", None, 0), (1, 0, 1, "A", "y", (0, 0, "C", 0.9), 1), (2, 0, 0, "C", "z", None, 0)]
    talk = spark.createDataFrame(rows, KEYED)
    assert pairs.build_pairs(talk).collect() == []
    assert [r["source"]["role"] for r in pairs.build_pairs(talk.drop("doc_id").where("dialogue <> 'z' OR true").withColumn("chunk_id", F.when(F.col("dialogue") == "z", 1).otherwise(0).cast("long"))).collect()] == ["C"]


def test_utterances_without_line_numbers(spark):
    rows = two(spark).drop("line_no")
    assert pairs.build_pairs(rows, strict=True).count() == 3
    twice = rows.unionByName(rows.where("dialogue = '1-1'").withColumn("dialogue", F.lit("other")))
    assert sorted(r["reply"]["text"] for r in pairs.build_pairs(twice, strict=True).where("doc_id = 1").collect()) == ["other", "other"]
    assert validate.errors(rows).collect() == []
    found = validate.errors(twice).collect()
    assert [(r["doc_id"], r["code"]) for r in found] == [(1, "E_DUP_INDEX")]
    gone = rows.withColumn("reply", F.when(F.col("reply").isNotNull(), F.col("reply").withField("target_chunk_id", F.lit(None).cast("long"))))
    assert {r["code"] for r in validate.errors(gone).collect()} == {"E_TARGET_CHUNK"}


def test_rules_are_kept_within_a_document(spark):
    link = lambda **more: {"target_index": 0, "confidence": 1} | more
    lines = [
        ("a", utterance()), ("a", utterance(index=1, role="B", reply=link())), ("a", utterance(chunk=2, reply=link(target_chunk_id=1))),
        ("b", utterance()), ("b", utterance(index=2)), ("b", utterance(chunk=1, reply=link(target_index=7, target_chunk_id=0))),
        ("c", "[1]"), ("d", utterance(chunk=1, reply=link(target_chunk_id=0))), ("d", utterance(index=1)),
    ]
    rows = spark.createDataFrame([(f, i, v) for i, (f, v) in enumerate(lines)], "file string, line_no long, value string").withColumn("v", F.try_parse_json("value"))
    found = sorted((r["file"], r["line_no"], r["code"]) for r in validate.errors(rows, ["file"]).where("line_no IS NOT NULL").collect())
    assert found == [("a", 2, "E_TARGET_CHUNK_MISSING"), ("b", 4, "E_GAP"), ("b", 5, "E_RANGE"), ("c", 6, "E_NOT_OBJECT"), ("d", 7, "E_TARGET_MISSING"), ("d", 8, "E_GAP")]
    assert [r["file"] for r in validate.errors(rows, ["file"]).where("code = 'E_EMPTY'").collect()] == ["c"]
    assert [(r["file"], r["code"]) for r in validate.errors(rows.limit(0), ["file"]).collect()] == [(None, "E_EMPTY")]
    for name in "abcd":  # each file alone is judged alike
        alone = validate.errors(rows.where(F.col("file") == name)).collect()
        together = validate.errors(rows, ["file"]).where(F.col("file") == name).drop("file").collect()
        assert sorted(map(str, alone)) == sorted(map(str, together))
    assert pairs.from_lines(rows, doc=["file"]).count() == 1
    with pytest.raises(ValueError, match="E_GAP"):
        pairs.from_lines(rows, validated=True, doc=["file"])


def test_statistics_and_chat_of_documents(spark):
    talk = two(spark)
    assert sorted((str(r["doc_id"]), r["chunk_id"], r["dialogues"]) for r in stats.chunk_stats(talk).collect()) == [("1", 0, 2), ("2", 0, 3), ("None", 0, 1)]
    assert {(r["from_role"], r["to_role"]): r["n"] for r in stats.transitions(talk).collect()} == {("A", "B"): 2, ("B", "A"): 1}
    assert stats.density(talk, per=["doc_id"]).where("doc_id = 2").first()["most"] == 3
    assert {r["doc_id"]: r["total"] for r in stats.length_summary(talk, per=["doc_id"]).collect()} == {1: 2, 2: 3, None: 1}
    assert {r["doc_id"]: r["role"] for r in stats.top_roles(talk, 1, ["doc_id"]).collect()} == {1: "A", 2: "A", None: "A"}
    assert [(r["doc_id"], r["dialogues"]) for r in stats.densest(talk, 1).collect()] == [(2, 3)]
    assert [r["dialogue"] for r in stats.ordered(talk).collect()] == ["None-0", "1-0", "1-1", "2-0", "2-1", "2-2"]
    samples = pairs.build_pairs(talk, strict=True)
    records = chat.convert(samples, "stitch", max_turns=9, meta=True)
    assert {r["doc_id"]: [m["content"] for m in r["messages"]][1:] for r in records.collect()} == {1: ["1-0", "1-1"], 2: ["2-0", "2-1", "2-2"]}
    assert {r["meta"]["doc_id"] for r in records.collect()} == {1, 2}
    assert sorted(r["doc_id"] for r in chat.convert(samples).collect()) == [1, 2, 2]


def test_what_is_left_of_documents(spark):
    ids = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (3, 0), (3, 1), (None, 0)], "doc_id long, chunk_id long")
    assert {r["doc_id"]: r["chunk_id"] for r in resume.first_missing(ids).collect()} == {1: 1, 2: 0, 3: 2, None: 1}
    left = resume.remaining(ids, ids.where("doc_id = 1 OR doc_id IS NULL"))
    assert sorted((r["doc_id"], r["chunk_id"]) for r in left.collect()) == [(2, 1), (3, 0), (3, 1)]
    left = resume.remaining(ids, ids.where("doc_id = 1").drop("doc_id"))  # markers without documents
    assert sorted(r["chunk_id"] for r in left.collect()) == [1, 1]
    rows = ids.withColumn("line_no", F.col("chunk_id") * 10)
    assert sorted((r["doc_id"], r["chunk_id"]) for r in resume.processed_ids(rows).collect()) == [(1, 0), (3, 0)]
    assert keys.utterance(ids) == ["doc_id", "chunk_id", "dialogue_index"]


# ---- runs --------------------------------------------------------------------------------------------------------------


@pytest.fixture
def model(tmp_path):
    """A call that writes down what it is asked, and fails or dies as a state file says."""
    log, state = tmp_path / "asked", tmp_path / "state"
    log.mkdir()
    state.write_text("up")

    def call(chunk, log=str(log), state=str(state)):
        import os
        import uuid

        mode = open(state).read()
        if mode.startswith("die") and len(os.listdir(log)) >= int(mode[3:]):
            os._exit(1)
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(chunk)
        if mode == "down":
            raise ValueError("down")
        lines = chunk.split("\n")
        return json.dumps([{"role": "AB"[i % 2], "dialogue": x, "reply": {"target_index": i - 1, "target_role": "AB"[(i - 1) % 2], "confidence": 0.9} if i else None} for i, x in enumerate(lines)])

    call.asked = lambda: sorted(p.read_text() for p in log.iterdir())
    call.state = state.write_text
    return call


SETTINGS = Settings(max_tokens=12, cover_tokens=0, max_retries=1, retry_delay=0.0, parallelism=1, wave_chunks=1)


def test_from_texts_to_records(spark, tmp_path, model):
    docs = spark.createDataFrame([(1, "how so\nwhy\nand now\nno"), (2, "who\nme\nyou")], "doc_id long, text string")
    found = run.run(docs, model, str(tmp_path / "out"), Settings(max_tokens=14, cover_tokens=0, retry_delay=0.0))
    assert validate.errors(found).collect() == []
    samples = pairs.build_pairs(found, strict=True)
    assert sorted((r["doc_id"], r["source"]["text"], r["reply"]["text"]) for r in samples.collect()) == [(1, "and now", "no"), (1, "how so", "why"), (2, "me", "you"), (2, "who", "me")]
    records = chat.convert(samples, "stitch", max_turns=5)
    assert sorted((r["doc_id"], r["chunk_id"], [m["content"] for m in r["messages"]][1:]) for r in records.collect()) == [(1, 0, ["how so", "why"]), (1, 1, ["and now", "no"]), (2, 0, ["who", "me", "you"])]
    kept = run.utterances(spark, str(tmp_path / "out"), keep_text=True)
    assert {r["chunk_text"] for r in kept.collect()} == {"how so\nwhy", "and now\nno", "who\nme\nyou"}


def test_a_run_that_is_killed_keeps_its_waves(spark, tmp_path, model):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} ..." for i in range(6)))], "doc_id long, text string")
    folder = str(tmp_path / "out")
    model.state("die2")
    with pytest.raises(Exception):
        run.run(docs, model, folder, SETTINGS)
    assert run.utterances(spark, folder).count() == 2 and run.completed(spark, folder).count() == 2
    assert len(model.asked()) == 2
    model.state("up")
    assert run.run(docs, model, folder, SETTINGS).count() == 6
    assert model.asked() == sorted(f"line {i} ..." for i in range(6))  # no chunk twice
    assert run.run(docs, model, folder, SETTINGS).count() == 6 and len(model.asked()) == 6
    rows = run.progress(spark, folder).orderBy("run", "batch").collect()
    assert [r["processed"] for r in rows if r["run"] == 1] == [1, 2] and [r["processed"] for r in rows if r["run"] == 2] == [1, 2, 3, 4]
    assert all(r["speed_cps"] > 0 and r["total"] >= r["processed"] for r in rows) and rows[0]["total"] == 6 and rows[0]["eta_sec"] > 0


def test_responses_are_those_of_the_content(spark, tmp_path, model):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "out")
    texts = lambda: sorted((r["doc_id"], r["chunk_id"], r["dialogue"]) for r in run.utterances(spark, folder).collect())
    run.run(frame([(1, "same here ..\nown text ..."), (2, "same here ..")]), model, folder, SETTINGS)
    assert model.asked() == ["own text ...", "same here .."]  # equal chunks once
    assert texts() == [(1, 0, "same here .."), (1, 1, "own text ..."), (2, 0, "same here ..")]
    run.run(frame([(2, "new text ...\nsame here ..")]), model, folder, SETTINGS)
    assert model.asked() == ["new text ...", "own text ...", "same here .."]
    assert texts() == [(1, 0, "same here .."), (1, 1, "own text ..."), (2, 0, "new text ..."), (2, 1, "same here ..")]
    run.run(frame([(2, None)]), model, folder, SETTINGS)
    assert texts() == [(1, 0, "same here .."), (1, 1, "own text ...")]
    run.run(frame([(1, "own text ...")]), model, folder, SETTINGS, prompt="another")
    assert len(model.asked()) == 4 and texts() == [(1, 0, "own text ...")]


def test_what_was_queued_for_another_prompt_is_passed_over(spark, tmp_path, model):
    docs = spark.createDataFrame([(1, "line one ...\nline two ...")], "doc_id long, text string")
    folder = str(tmp_path / "out")
    model.state("die0")
    with pytest.raises(Exception):
        run.run(docs, model, folder, SETTINGS, prompt="a")
    model.state("up")
    assert run.run(docs, model, folder, SETTINGS, prompt="b").count() == 2
    assert model.asked() == ["line one ...", "line two ..."]


def test_a_chunk_that_fails_twice_is_one_failure(spark, tmp_path, model):
    docs = spark.createDataFrame([(1, "line one ...\nline two ...")], "doc_id long, text string")
    folder = str(tmp_path / "out")
    model.state("down")
    for _ in range(2):
        with pytest.raises(RuntimeError, match="2 chunks"):
            run.run(docs, model, folder, SETTINGS)
    assert run.failures(spark, folder).count() == 2 and len(model.asked()) == 4
    assert [r["failed"] for r in run.progress(spark, folder).orderBy("run", "batch").collect()] == [1, 2, 1, 2]
    model.state("up")
    assert run.run(docs, model, folder, SETTINGS).count() == 2 and run.failures(spark, folder).count() == 0


def test_a_wave_that_is_replayed_is_not_asked_for_again(spark, tmp_path, model):
    """Responses were written, and the run broke before its checkpoint moved on."""
    docs = spark.createDataFrame([(1, "line one ...\nline two ...")], "doc_id long, text string")
    folder = str(tmp_path / "out")
    run.run(docs, model, folder, SETTINGS)
    stream = next((tmp_path / "out" / "checkpoint").iterdir())
    for name in ("1", ".1.crc"):
        if (stream / "commits" / name).exists():
            os.remove(stream / "commits" / name)
    time.sleep(0.1)
    assert run.run(docs, model, folder, SETTINGS).count() == 2
    assert len(model.asked()) == 2


# ---- segmentation by rows ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("limit", "cover"), [(10, 4), (12, 11), (7, 0), (30, 9)])
def test_rows_give_the_chunks_of_the_fold(spark, limit, cover):
    rng = random.Random(limit)
    piece = lambda: "".join(rng.choice("ab。?!c") for _ in range(rng.choice([1, 2, 3, 5, limit - 1, limit, limit + 1, 3 * limit])))
    texts = [(i, "\n".join(piece() for _ in range(rng.choice([0, 1, 2, 9, 80])))) for i in range(25)]
    texts += [(100, None), (101, " \n　\n"), (102, "x\n" * 300), (103, "\n".join("y" * limit for _ in range(9))), (104, "z" * (9 * limit)), (None, "aa\nbb\ncc\ndd")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    order = lambda df: sorted(map(str, ((r["doc_id"], r["chunk_id"], r["chunk_text"]) for r in df.collect())))
    got = order(cuts.segment_rows(docs, None, limit, cover))
    assert got == order(segment.segment(docs, len, limit, cover)) and len(got) > 50
    if limit == 10:
        assert order(cuts.segment_rows(docs, lambda text: (len(text) + 1) // 2, limit, cover)) == order(segment.segment(docs, lambda text: (len(text) + 1) // 2, limit, cover))
        assert cuts.segment_rows(docs.limit(0)).count() == 0


def test_lines_are_joined_without_arrays_of_texts(spark):
    """A document of very many lines is dealt over blocks: no plan gathers more than a chunk's lines."""
    lines = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    found = cuts.segment_lines(lines, None, 40, 12).orderBy("chunk_id").collect()
    assert [r["chunk_text"] for r in found] == segment.fold([f"line {i}" for i in range(5000)], len, 40, 12)


def test_chunks_of_a_tokenizer_are_those_of_the_fold(spark):
    counter = segment.token_counter(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "A first line of words.\nSecond line!\n" + "Long sentence? " * 9 + "\nend"), (2, "one\ntwo")], "doc_id long, text string")
    rows = lambda df: sorted((r["doc_id"], r["chunk_id"], r["chunk_text"]) for r in df.collect())
    assert rows(cuts.segment_rows(docs, counter, 14, 4)) == rows(segment.segment(docs, counter, 14, 4))


# ---- schemas -----------------------------------------------------------------------------------------------------------


def test_a_schema_goes_through_prompt_parsing_and_validation(spark, tmp_path):
    schema = Schema.of({
        "task_description": "Find what is said.",
        "attributes": [{"name": "role", "type": "String", "description": "who"}, {"name": "tone", "type": "String|null", "description": "one word"}, {"name": "loud", "type": "Bool"}, {"name": "words", "type": "int"}, {"name": "to", "type": "list", "optional": True}],
        "example": [{"text": "x", "script": []}],
    })
    text = schema.prompt(4)
    assert all(x in text for x in ("Find what is said.", "role: string  // who", "tone: string | null  // one word", "loud: boolean", "words: integer", "to: [string] | null", '"script": []', "at most 4"))
    items = [{"role": "A", "dialogue": "x", "tone": " dry ", "loud": True, "words": 3, "to": ["B", "C"]}, {"role": "B", "dialogue": "y", "tone": 5, "loud": "yes", "words": 1.5, "to": "B"}, {"role": "A", "dialogue": "z", "loud": False, "words": 1, "to": []}]
    rows = spark.createDataFrame([(0, json.dumps(items))], "chunk_id long, response string")
    found = parse.utterances(parse.script(rows), schema=schema)
    assert [(r["tone"], r["loud"], r["words"], r["to"]) for r in found.orderBy("dialogue_index").collect()] == [("dry", True, 3, ["B", "C"]), (None, None, None, None), (None, False, 1, [])]
    assert dict(found.dtypes)["words"] == "bigint" and dict(found.dtypes)["to"] == "array<string>"
    assert sorted(r["code"] for r in validate.errors(found, schema=schema).collect()) == ["E_ATTRIBUTE:loud", "E_GAP"]
    assert validate.errors(found).collect() == []
    lines = spark.createDataFrame([(i, json.dumps({"chunk_id": 0, "dialogue_index": i} | x)) for i, x in enumerate(items)], "line_no long, value string").withColumn("v", F.try_parse_json("value"))
    assert [(r["line_no"], r["code"]) for r in validate.errors(lines, schema=schema).orderBy("line_no", "code").collect()] == [(1, "E_ATTRIBUTE:tone"), (2, "E_GAP")]
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    out = run.run(docs, lambda chunk: json.dumps([{"role": "A", "dialogue": chunk, "loud": True, "words": 3}]), str(tmp_path / "out"), schema=schema)
    assert [(r["dialogue"], r["words"], r["tone"]) for r in out.collect()] == [("a b c", 3, None)] and validate.errors(out, schema=schema).collect() == []
    for bad in ({"name": "role_x y"}, {"name": "chunk_id"}, {"name": "n", "type": "date"}):
        with pytest.raises(ValueError):
            Schema.of({"attributes": [bad]})
    with pytest.raises(ValueError, match="twice"):
        Schema.of({"attributes": [{"name": "n"}, {"name": "n"}]})


def test_targets_are_mapped_to_what_is_kept(spark):
    items = [{"role": "A", "dialogue": "a"}, {"role": " ", "dialogue": "gone"}, {"role": "B", "dialogue": "b", "reply": {"target_index": 0}}, 5, {"role": "A", "dialogue": "c", "reply": {"target_index": 2}}, {"role": "B", "dialogue": "d", "reply": {"target_index": 1}}, {"role": "A", "dialogue": "e", "reply": {"target_index": 5}}, {"role": "A", "dialogue": "f", "reply": {"target_index": 9}}]
    rows = parse.script(spark.createDataFrame([(0, json.dumps(items)), (1, json.dumps(items[:1]))], "chunk_id long, response string"))
    links = lambda **more: [r["reply"] and r["reply"]["target_index"] for r in parse.utterances(rows, **more).where("chunk_id = 0").orderBy("dialogue_index").collect()]
    assert links(remap=True) == [None, 0, 1, None, 3, None]
    assert links() == [None, 0, None, 1, None, None]


# ---- stitching by links ------------------------------------------------------------------------------------------------

PAIR = "source struct<chunk_id: bigint, dialogue_index: bigint, role: string, text: string>, reply struct<chunk_id: bigint, dialogue_index: bigint, role: string, text: string>, pair struct<from: string, to: string>, confidence double"


def forests(seed, n=40):
    """Edges of random forests in several buckets of two documents, a chain above 100 turns, and buckets that are no forests."""
    rng = random.Random(seed)
    rows = []

    def edge(doc, chunk, a, b, r_chunk=None):
        ra, rb = "AB"[a % 2], "AB"[(a + 1) % 2]
        rows.append((doc, (chunk, a, ra, f"{a}"), (chunk if r_chunk is None else r_chunk, b, rb, f"{b}"), (ra, rb), 1.0))

    for doc in (1, 2):
        for chunk in range(4):
            for i in range(1, n):
                if rng.random() < 0.8 and (before := [j for j in range(i) if (i - j) % 2]):
                    edge(doc, chunk, rng.choice(before[-4:]), i)
    for i in range(1, 250):
        edge(1, 50, i - 1, i)
    for i in range(1, 9):  # repeated samples, a reply before its source, a reply in another chunk
        edge(1, 60, i - 1, i)
        edge(1, 60, i - 1, i)
        edge(2, 61, i, i - 1)
        edge(2, 62, i - 1, i, 62 if i % 3 else 63)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [1, 3, 100, 1000])
def test_links_give_the_sessions_of_the_fold(spark, turns):
    samples = spark.createDataFrame(forests(turns), "doc_id long, " + PAIR).repartition(3)
    key = ("doc_id", "chunk_id", "role_a", "role_b", "session", "place")
    rows = lambda limit: sorted(tuple(r[c] for c in key) + (r["source"]["dialogue_index"], r["reply"]["dialogue_index"], r["reply"]["chunk_id"]) for r in chat.sessions(samples, turns, bucket_rows=limit).collect())
    assert rows(0) == rows(10_000)
    if turns == 100:
        records = lambda limit: sorted(map(str, chat.stitched(samples, turns, meta=True, bucket_rows=limit).collect()))
        assert records(5) == records(10_000)
    assert chat.sessions(samples.limit(0), turns, bucket_rows=0).count() == 0


# ---- ordered parts, SQL, settings --------------------------------------------------------------------------------------


def test_order_survives_appends(spark, tmp_path):
    folder = str(tmp_path / "table")
    rng = random.Random(3)
    want = []
    for start in (0, 1000, 500):
        keys_ = [(i, f"r{i}") for i in range(start, start + 400)] + [(None, "none")] * (start == 0)
        rng.shuffle(keys_)
        added = ordered.append(spark.createDataFrame(keys_, "k long, v string").repartition(3), folder, ["k"], rows_a_file=70)
        assert added == len(keys_)
        want += [v for _, v in sorted(keys_, key=lambda r: (r[0] is not None, r[0]))]
        assert ordered.is_sorted(spark, folder, ["k"]) is (start != 500)
    assert ordered.append(spark.createDataFrame([], "k long, v string"), folder, ["k"]) == 0
    found = ordered.read(spark, folder)
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in found.collect()] == want
    lines = ordered.manifest(spark, folder).collect()
    assert len(lines) > 12 and [r["before"] for r in lines] == [sum(x["rows"] for x in lines[:i]) for i in range(len(lines))]
    assert [r["v"] for r in ordered.stretch(spark, folder, 395, 20).collect()] == want[395:415]
    assert len(ordered.stretch(spark, folder, 395, 20).inputFiles()) < 4
    spark.createDataFrame([(7, "broken")], "k long, v string").write.parquet(f"{folder}/parts/left")  # an append that broke
    assert ordered.read(spark, folder).count() == len(want)


def test_the_table_function_gives_the_chunks_of_the_fold(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, "\n".join("".join(rng.choice("ab。c") for _ in range(rng.choice([1, 3, 9, 10, 11, 40]))) for _ in range(rng.choice([0, 1, 30])))) for i in range(30)], "doc_id long, text string")
    surface.register(spark)
    assert surface.views(docs=docs, prefix="t_") == ["t_documents", "t_lines"]
    for limit, cover in ((10, 4), (12, 11), (9, 0)):
        found = spark.sql(f"SELECT * FROM segment_lines(TABLE(SELECT * FROM t_lines) PARTITION BY (doc_id) ORDER BY (line_no), {limit}, {cover})")
        assert sorted(map(tuple, found.collect())) == sorted((r["doc_id"], r["chunk_id"], r["chunk_text"]) for r in segment.segment(docs, len, limit, cover).collect())


def test_a_window_that_is_no_number_is_the_usual_one():
    assert [Settings(reply_window=x).reply_window for x in ("x", None, -3, 0, "4", 9)] == [6, 6, 0, 0, 4, 9]
    assert Settings.from_env({"CONVOFLOW_REPLY_WINDOW": "many"}).reply_window == 6
    assert Settings.from_env({"CONVOFLOW_REMAP_TARGETS": "on", "CONVOFLOW_WAVE_CHUNKS": "9"}) == Settings(remap_targets=True, wave_chunks=9)


def test_platforms_need_their_key():
    found = platform("openai", {"OPENAI_API_KEY": "k"})
    assert found["model"] and found["base_url"].startswith("https://") and found["api_key"] == "k"
    assert platform("openai", {"OPENAI_API_KEY": "k", "OPENAI_MODEL_NAME": "m", "OPENAI_BASE_URL": "u"})["model"] == "m"
    with pytest.raises(ValueError, match="set GEMINI_API_KEY.*choose one that has its key: openai"):
        platform("gemini", {"OPENAI_API_KEY": "k"})
    with pytest.raises(ValueError, match="the key of another"):
        platform("gemini", {})
    with pytest.raises(ValueError, match="unknown platform"):
        platform("none", {})


# ---- counts of tokens and the memory they take ------------------------------------------------------------------------


def test_a_long_line_is_counted_and_cut_once(spark, tmp_path):
    told = str(tmp_path / "told")

    def tokens(text):
        with open(told, "a", encoding="utf-8") as out:
            out.write(text + "\n")
        return len(text)

    lines = spark.createDataFrame([(1, n, " ".join(f"{n}-{i}?" for i in range(30))) for n in range(4)], "doc_id long, line_no long, line string")
    found = cuts.segment_lines(lines, tokens, 40, 12).orderBy("chunk_id").collect()
    with open(told, encoding="utf-8") as asked:
        texts = asked.read().splitlines()
    assert len(texts) == len(set(texts)) > 100
    assert [r["chunk_text"] for r in found] == segment.fold([r["line"] for r in lines.orderBy("line_no").collect()], len, 40, 12)


def test_pieces_are_counted_as_the_library_counts_whole_texts():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library, counter, rng = Tokenizer.from_file(path), segment.token_counter(path), random.Random(11)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    marks = [" ", "  ", "\t", "\xa0", "\x1c", "　", "?", "!", "。", "a", "I'll", "'s", "word", "漢字", "123", "<|endoftext|>", "-", "\x85", " 'm", "é", "\n", "😀"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 25))) for _ in range(600)]
    assert counter.many(texts) == [count(t) for t in texts]
    for text in texts:
        parts = [p for p in segment._ENDS.split(text) if p]
        assert [counter.packed(parts, n) for n in (3, 9)] == [segment._joined(parts, count, n) for n in (3, 9)]


def test_packing_sentences_hands_each_text_to_the_library_about_once(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    sizes = segment._Sizes(path)
    monkeypatch.setattr(segment, "_sizes_by", lambda _: sizes)
    asked, library = [], sizes.tokenizer

    class Told:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    sizes.tokenizer = Told()
    line = " ".join(f"word{i} of{i} it{i}?" for i in range(3000))
    found = segment.cut_line(line, segment.token_counter(path), 512)
    assert "".join(found) == line and len(found) > 20
    assert sum(map(len, asked)) < 2 * len(line)


def test_documents_are_segmented_by_small_batches(spark):
    session = spark.newSession()
    docs = session.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 1000) AS text")
    size = F.arrow_udf(lambda texts: pa.array([texts.nbytes] * len(texts), pa.int64()), "long")
    made = segment.segment(docs)
    assert docs.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES
    assert made.count() == 4000
