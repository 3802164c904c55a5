"""Golden rows, fault rows and edge cases of the operators."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from convoflow.config import Settings, endpoint
from convoflow.functions import text
from convoflow.operators import chat, extract, pairs, parse, segment, stats, validate
from convoflow.sources import jsonl, sinks
from convoflow.streaming import resume

LINES = ["Is the night ferry late again?", "Only by an hour. The fog is thick.", "Then I will wait here.", "Tea?", "Yes, with honey if you have some.", "I have a little left.", "Who runs the lamp now?", "My sister does."]
CONFIDENCE = [None, 0.97, 0.81, 0.9, 0.85, 0.99, 0.88, 0.9]
SCHEMA = "chunk_id long, dialogue_index long, role string, dialogue string, reply struct<target_index: bigint, target_chunk_id: bigint, target_role: string, confidence: double>, line_no long"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(0, i, "AB"[i % 2], line, (i - 1, 0, "AB"[(i - 1) % 2], CONFIDENCE[i]) if i else None, i + 1) for i, line in enumerate(LINES)]
    return spark.createDataFrame(rows, SCHEMA)


def edges(samples):
    return sorted((r["source"]["dialogue_index"], r["reply"]["dialogue_index"]) for r in samples.collect())


def test_statistics(talk):
    row = stats.length_summary(talk).first()
    sizes = [len(x) for x in LINES]
    ordered = sorted(sizes)
    assert (row["total"], row["roles"], row["chars"], row["average"], row["least"], row["p90"], row["p99"], row["most"]) == (8, 2, sum(sizes), sum(sizes) / 8, min(sizes), max(sizes), max(sizes), max(sizes))
    assert row["p50"] == (ordered[3] + ordered[4]) / 2
    assert {r["role"]: (r["n"], r["chars"], r["average"]) for r in stats.role_stats(talk).collect()} == {r: (4, sum(sizes[i::2]), sum(sizes[i::2]) / 4) for i, r in enumerate("AB")}
    assert {(r["from_role"], r["to_role"]): r["n"] for r in stats.transitions(talk).collect()} == {("A", "B"): 4, ("B", "A"): 3}
    chunk = stats.chunk_stats(talk).first()
    assert (chunk["dialogues"], chunk["chars"], chunk["roles"]) == (8, sum(sizes), {"A": 4, "B": 4})
    assert stats.length_summary(talk.limit(0)).first()["total"] == 0


def test_pairs(talk):
    wanted = pairs.wanted_pairs(talk)
    found = pairs.build_pairs(talk, wanted, strict=True)
    assert edges(found) == [(i, i + 1) for i in range(7)]
    assert {(r["from_role"], r["to_role"]): r["n"] for r in pairs.pair_counts(found).collect()} == {("A", "B"): 4, ("B", "A"): 3}
    assert edges(pairs.build_pairs(talk, strict=True)) == edges(found)
    high = pairs.build_pairs(talk, wanted, min_confidence=0.89, strict=True)
    assert {(r["from_role"], r["to_role"]) for r in pairs.pair_counts(high).collect()} == {("A", "B")}
    assert edges(pairs.build_pairs(talk, pairs.wanted_pairs(talk, ["ALL,A"]))) == [(1, 2), (3, 4), (5, 6)]
    with pytest.raises(ValueError):
        pairs.wanted_pairs(talk, ["A-B"])


def test_pairs_fallback_duplicates_and_nan(spark):
    rows = [(0, 0, "A", "x", None, 1), (0, 1, "B", "y", (0, 0, "C", 0.9), 2), (0, 1, "B", "z", (0, 0, "C", float("nan")), 3), (0, 2, "C", "w", (2, None, None, 0.9), 4)]
    talk = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([("C", "B")], "from_role string, to_role string")
    found = pairs.build_pairs(talk, wanted, min_confidence=None).collect()
    assert [(r["source"]["role"], r["reply"]["text"]) for r in found] == [("C", "z")] * 2  # the last counts, once for each
    assert pairs.build_pairs(talk, wanted).collect() == []  # NaN is no confidence
    assert pairs.build_pairs(talk, wanted, min_confidence=None, strict=True).collect() == []


def test_a_null_chunk_leads_nowhere(spark):
    value = lambda i, more: json.dumps({"chunk_id": 0, "dialogue_index": i, "role": "AB"[i % 2], "dialogue": "x", "reply": {"target_index": 0, "confidence": 1.0} | more} if i else {"chunk_id": 0, "dialogue_index": 0, "role": "A", "dialogue": "x"})
    lines = [value(0, {}), value(1, {"target_chunk_id": None}), value(3, {}), value(5, {"target_chunk_id": 0}), value(7, {"target_chunk_id": 4})]
    rows = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(lines)], "file string, line_no long, value string").withColumn("v", F.try_parse_json("value"))
    assert edges(pairs.from_lines(rows)) == [(0, 3), (0, 5)]
    assert edges(pairs.from_lines(rows, ["A,B"])) == [(0, 3), (0, 5)]
    with pytest.raises(ValueError, match="E_TARGET_CHUNK"):
        pairs.from_lines(rows, validated=True)
    assert edges(pairs.from_lines(rows.where("line_no = 1"), validated=True)) == []


def test_role_mentions(spark):
    lines = ['{"pair": {"from": "A", "to": "B"}, "source": {"role": "A"}, "reply": {"role": "B"}}', '{"from_role": "A", "to_role": "C"}', "[1]", "no", '{"pair": {"from": ""}}']
    rows = spark.createDataFrame([(x,) for x in lines], "value string").withColumn("v", F.try_parse_json("value"))
    assert {r["role"]: r["n"] for r in pairs.role_mentions_of_lines(rows).collect()} == {"A": 3, "B": 2, "C": 1}


def test_chat(talk):
    samples = pairs.build_pairs(talk, pairs.wanted_pairs(talk), strict=True)
    single = chat.convert(samples).collect()
    assert len(single) == 7
    assert [m["role"] for m in single[0]["messages"]] == ["system", "user", "assistant"]
    found = {r["session"]: [(m["role"], m["content"]) for m in r["messages"]][1:] for r in chat.convert(samples, "stitch", max_turns=4).collect()}
    assert found[0] == [("user", LINES[0]), ("assistant", LINES[1]), ("user", LINES[2]), ("assistant", LINES[3]), ("user", LINES[4])]
    assert found[1] == [("user", LINES[4]), ("assistant", LINES[5]), ("user", LINES[6]), ("assistant", LINES[7])]
    back = {r["session"]: [(m["role"], m["content"]) for m in r["messages"]][1:] for r in chat.convert(samples, "stitch", max_turns=4, reverse=True).collect()}
    assert back[1] == [("user", LINES[5]), ("assistant", LINES[4]), ("assistant", LINES[6]), ("user", LINES[7])]
    assert chat.convert(samples, system_template="{from_role}->{nobody}").first()["messages"][0]["role"] == "user"
    assert chat.convert(samples.where("pair.from = 'A'"), system_template="{from_role}->{to_role}").first()["messages"][0]["content"] == "A->B"
    with pytest.raises(ValueError):
        chat.convert(samples, "other")


def test_stitching_of_branches(spark):
    links = [(0, 1), (0, 3), (1, 2), (3, 4), (3, 6)]
    rows = [(0, i, "AB"[i % 2], f"t{i}", None, i) for i in range(7)]
    side = lambda i: (0, i, "AB"[i % 2], f"t{i}")
    samples = spark.createDataFrame([(side(a), side(b), ("AB"[a % 2], "AB"[b % 2]), 1.0) for a, b in links], "source struct<chunk_id: bigint, dialogue_index: bigint, role: string, text: string>, reply struct<chunk_id: bigint, dialogue_index: bigint, role: string, text: string>, pair struct<from: string, to: string>, confidence double")

    def chains(turns):
        out = {}
        for r in chat.sessions(samples, turns).collect():
            out.setdefault(r["session"], []).append((r["place"], r["source"]["dialogue_index"], r["reply"]["dialogue_index"]))
        return sorted([tuple(x[1:]) for x in sorted(v)] for v in out.values())

    assert chains(10) == [[(0, 1), (1, 2)], [(0, 3), (3, 4)], [(3, 6)]]
    assert len(chains(1)) == 5
    assert rows


@pytest.mark.parametrize(
    ("lines", "limits", "chunks"),
    [
        ("abc\ndefg\nhij\nklmnop", (10, 4), ["abc\ndefg", "defg\nhij", "hij\nklmnop"]),
        ("abcd\nefghijklm", (10, 4), ["abcd", "efghijklm"]),
        ("abcdefghij", (10, 4), ["abcdefghij"]),
        ("你好。走吗？abcdefgh", (6, 2), ["你好。走吗？", "abcdefgh"]),
        (" \n\r\n　ab　\r\n cd", (10, 4), ["ab\ncd"]),
        (None, (10, 4), []),
    ],
)
def test_segments(spark, lines, limits, chunks):
    docs = spark.createDataFrame([(1, lines)], "doc_id long, text string")
    assert [r["chunk_text"] for r in segment.segment(docs, len, *limits).orderBy("chunk_id").collect()] == chunks


def test_segments_hold_every_line_and_the_limit():
    rng = random.Random(4)
    for _ in range(300):
        found = ["x" * rng.randint(1, 14) for _ in range(rng.randint(0, 12))]
        chunks = segment.fold(found, len, 12, 5)
        assert all(any(f in c.split("\n") for c in chunks) for f in found)
        assert all(sum(map(len, c.split("\n"))) <= 12 or "\n" not in c for c in chunks)


def test_parsing(spark):
    good = json.dumps([{"role": "A", "dialogue": "x"}, {"role": "B", "dialogue": "y]", "reply": {"target_index": 0}}])
    cases = {1: good, 2: '{"script": %s}' % good, 3: f"```json\n{good}\n```", 4: f"<think>[1]</think>{good}", 5: f"text</think>{good}", 6: f"see [not json] then {good} end", 8: '{"a": 1}', 9: '[{"role": " ", "dialogue": "x"}, {"role": "A", "dialogue": ""}, 5, {"role": "C", "dialogue": "z"}]', 10: None}
    rows = spark.createDataFrame(list(cases.items()), "chunk_id long, response string").withColumn("response", parse.strip_reasoning(F.col("response")))
    read = parse.script(rows)
    assert {r["chunk_id"]: r["parse_status"] for r in read.collect()} == {k: "failed" if k in (8, 10) else "ok" for k in cases}
    found = {}
    for r in parse.utterances(read).orderBy("chunk_id", "dialogue_index").collect():
        found.setdefault(r["chunk_id"], []).append((r["dialogue_index"], r["role"], r["dialogue"], r["reply"] and (r["reply"]["target_index"], r["reply"]["confidence"])))
    assert all(found[k] == [(0, "A", "x", None), (1, "B", "y]", (0, 1.0))] for k in (1, 2, 3, 4, 5, 6))
    assert found[9] == [(0, "C", "z", None)]
    assert [r["parse_status"] for r in parse.script(rows.where("chunk_id < 4"), fail_on_parse_error=True).collect()] == ["ok"] * 3
    with pytest.raises(Exception, match="no JSON list"):
        parse.script(rows, fail_on_parse_error=True).collect()


def test_first_array():
    deep = "[" * 30_000 + "1" + "]" * 30_000
    assert parse.first_array("[" * 50_000 + " then [1, 2] end") == "[1, 2]"
    assert (parse.first_array(deep) or "[").startswith("[")
    assert parse.first_array('say "[1]" and [2, "a]b"]') == "[1]"
    assert parse.first_array('"x [3" [4') is None
    assert parse.first_array('{"a": [oops] } [[1], {"b": "]["}]') == '[[1], {"b": "]["}]'
    assert parse.first_array(None) is None and parse.first_array("]") is None


def test_reply_links(spark):
    cases = [(5, -1, 0.9), (5, 5, 0.9), (8, 1, 0.9), (5, 4, 0.64), (5, 4, float("nan")), (5, None, 0.9), (5, 4, 0.65), (6, 0, 1.0)]
    rows = spark.createDataFrame(cases, "i long, t long, c double")
    assert [r["k"] for r in rows.select(parse.clean_reply(F.col("i"), F.col("t"), F.col("c")).alias("k")).collect()] == [False] * 6 + [True] * 2


def utterance(chunk=0, index=0, role="A", dialogue="x", reply=None, **more):
    return json.dumps({"chunk_id": chunk, "dialogue_index": index, "role": role, "dialogue": dialogue, "reply": reply} | more)


@pytest.mark.parametrize(
    ("lines", "codes"),
    [
        ([utterance(), utterance(index=1, reply={"target_index": 0, "confidence": 1})], []),
        (['{"a":'], ["E_EMPTY", "E_JSON"]),
        ([utterance(), "[1]"], ["E_NOT_OBJECT"]),
        ([utterance(), utterance(chunk=-1)], ["E_CHUNK_ID"]),
        ([utterance(), '{"chunk_id": true}'], ["E_CHUNK_ID"]),
        ([utterance(), '{"chunk_id": 0.0}'], ["E_CHUNK_ID"]),
        ([], ["E_EMPTY"]),
        ([utterance(), utterance(index=-1)], ["E_INDEX"]),
        ([utterance(), utterance()], ["E_DUP_INDEX"]),
        ([utterance(), utterance(index=2)], ["E_GAP"]),
        ([utterance(role=" ")], ["E_ROLE"]),
        ([utterance(dialogue="")], ["E_DIALOGUE"]),
        ([utterance(reply="x")], ["E_REPLY_TYPE"]),
        ([utterance(reply={"target_index": True, "confidence": 1})], ["E_TARGET_INDEX"]),
        ([utterance(reply={"target_index": 0, "confidence": 1})], ["E_NOT_EARLIER"]),
        ([utterance(role=""), utterance(index=1, reply={"target_index": 0, "confidence": 1})], ["E_GAP", "E_ROLE", "E_TARGET_MISSING"]),
        ([utterance(reply={"target_index": 0, "target_chunk_id": None, "confidence": 1})], ["E_TARGET_CHUNK"]),
        ([utterance(reply={"target_index": 0, "target_chunk_id": 9, "confidence": 1})], ["E_TARGET_CHUNK_MISSING"]),
        ([utterance(reply={"target_index": 0, "target_chunk_id": 1, "confidence": 1}), utterance(chunk=1)], ["E_FUTURE_CHUNK"]),
        ([utterance(), utterance(chunk=1, reply={"target_index": 4, "target_chunk_id": 0, "confidence": 1})], ["E_RANGE"]),
        ([utterance(), utterance(index=1, reply={"target_index": 0, "confidence": 1.01, "target_role": 5})], ["E_CONFIDENCE", "E_TARGET_ROLE"]),
    ],
)
def test_validation(spark, lines, codes):
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string").withColumn("v", F.try_parse_json("value"))
    assert sorted(r["code"] for r in validate.errors(rows).collect()) == codes


def test_legality(spark):
    cases = [("ok", True), ("", False), ("  ", False), ("a\x00b", False), ("a\x7fb", False), ("a\x9fb", False), ("a\tb\nc", True), ("a\ufffdb", False), ("SPAM x", False), (None, False)]
    rows = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["want"] == r["got"] for r in rows.select("want", text.legal(F.col("t"), deny=["^SPAM", "(", "(?P<x>PAM)", "a(?(1)b|c)"]).alias("got")).collect())
    assert spark.range(1).select(text.legal(F.lit(" abc "), 1, 3)).first()[0]


def test_files(spark, tmp_path, talk):
    (tmp_path / "a.jsonl").write_text(utterance() + "\n\n" + '{"bad\n' + "[1]\n" + json.dumps({"chunk_id": "1", "dialogue_index": 1.9, "role": "B", "text": "t", "reply": {"target_index": 0, "confidence": "0.5"}}), encoding="utf-8")
    rows = jsonl.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert [(r["line_no"], r["reason"]) for r in jsonl.rejects(rows).orderBy("line_no").collect()] == [(3, "E_JSON"), (4, "E_NOT_OBJECT")]
    found = jsonl.utterances(rows).orderBy("line_no").collect()
    assert [(r["chunk_id"], r["dialogue_index"], r["dialogue"]) for r in found] == [(0, 0, "x"), (1, 1, "t")]
    assert found[1]["reply"]["confidence"] == 0.5
    assert stats.invalid_lines(rows).first()[0] == 1
    samples = pairs.build_pairs(talk, pairs.wanted_pairs(talk), strict=True)
    sinks.write_pairs(samples, str(tmp_path / "pairs"))
    again = jsonl.pairs(jsonl.json_lines(spark, str(tmp_path / "pairs"), recursive=True))
    assert edges(again) == edges(samples)
    with pytest.raises(ValueError):
        sinks.write_pairs(samples)
    sinks.write_pairs(samples, merged=str(tmp_path / "merged"))
    lines = jsonl.pairs(jsonl.json_lines(spark, str(tmp_path / "merged")))
    assert [r["pair"]["from"] for r in lines.orderBy("file", "line_no").collect()] == ["A"] * 4 + ["B"] * 3
    assert edges(lines) == edges(samples)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 900), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"i": {i}}}\n' + ("\n" if i % 7 == 0 else "") for i in range(n)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = jsonl.json_lines(spark, jsonl.discover(spark, [str(tmp_path)]))
        assert rows.rdd.getNumPartitions() > 3
        found = {(r["file"][-7], r["line_no"]): r["i"] for r in rows.select("file", "line_no", F.try_variant_get("v", "$.i", "int").alias("i")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(name, i + 1 + (i + 6) // 7): i for name, n in (("a", 900), ("b", 3)) for i in range(n)}


def test_discovery_and_strict_reading(spark, tmp_path):
    for name in ("b.jsonl", "a.JSONL", "c.txt"):
        (tmp_path / name).write_text('{"x": 1}\n', encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jsonl").write_text('{"x": 1}\nno\n', encoding="utf-8")
    names = lambda *inputs, **more: [p.rpartition("/")[2] for p in jsonl.discover(spark, list(inputs), **more)]
    root = str(tmp_path)
    assert names(root) == ["a.JSONL", "b.jsonl"] and names(root, recursive=True) == ["a.JSONL", "b.jsonl", "d.jsonl"]
    assert names(f"{root}/*", f"{root}/b.jsonl", root) == ["a.JSONL", "b.jsonl"] and names(f"{root}/c.txt") == ["c.txt"]
    with pytest.warns(UserWarning, match="no input"):
        assert names(f"{root}/none") == []
    good, bad = (jsonl.strict(jsonl.json_lines(spark, f"{root}/{n}")) for n in ("b.jsonl", "sub/d.jsonl"))
    assert good.select("v").count() == 1 and good.collect()
    with pytest.raises(Exception, match="d.jsonl:2"):
        bad.collect()


def test_text_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text(f"text of {name}\n", encoding="utf-8")
    assert [(r["doc_id"], r["text"]) for r in jsonl.documents(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(i, f"text of {n}\n") for i, n in enumerate("abc")]


def test_copies(spark, tmp_path, talk):
    sinks.write_copy(talk.orderBy(F.desc("line_no")), str(tmp_path / "sorted"))
    lines = jsonl.json_lines(spark, str(tmp_path / "sorted"))
    assert [r["dialogue_index"] for r in jsonl.utterances(lines).orderBy("file", "line_no").collect()] == list(range(8))
    sinks.write_copy(talk, str(tmp_path / "none"), chunk_ids=[5])
    with pytest.raises(Exception, match="no chunk_id"):
        stats.of_chunks(talk.withColumn("chunk_id", F.lit(None).cast("long")), [1]).collect()
    assert validate.validated_copy(lines.where("line_no < 0"), str(tmp_path / "v")) is False
    ok = spark.createDataFrame([("f", i + 1, utterance(index=i)) for i in range(3)], "file string, line_no long, value string").withColumn("v", F.try_parse_json("value"))
    assert validate.validated_copy(ok, str(tmp_path / "v")) and [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()] == [utterance(index=i) for i in range(3)]


def test_conversion_of_files(spark, tmp_path, talk):
    samples = pairs.build_pairs(talk, strict=True)
    sinks.write_json_lines(samples.unionByName(samples), str(tmp_path / "pairs"))
    assert chat.convert_files(spark, [str(tmp_path / "pairs")], str(tmp_path / "chat"), dedupe=True) == 7
    assert chat.convert_files(spark, [str(tmp_path / "pairs")], str(tmp_path / "chat"), "stitch", max_turns=9, dedupe=True, meta=True) == 1
    assert len(json.loads(spark.read.text(str(tmp_path / "chat")).first()[0])["messages"]) == 9


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    from convoflow.streaming import run

    docs = spark.createDataFrame([(1, "good one\nbad two\ngood three"), (2, "good four"), (3, None)], "doc_id long, text string")
    asked = tmp_path / "asked"
    asked.mkdir()
    (tmp_path / "state").write_text("down")

    def call(chunk, state=str(tmp_path / "state"), log=str(asked)):
        import hashlib

        with open(f"{log}/{hashlib.sha1(chunk.encode()).hexdigest()}", "a") as f:
            f.write("x")
        if "bad" in chunk and open(state).read() == "down":
            raise ValueError("down")
        return json.dumps([{"role": "A", "dialogue": chunk}, {"role": "B", "dialogue": "yes", "reply": {"target_index": 0}}])

    settings = Settings(max_tokens=12, cover_tokens=0, max_retries=1, retry_delay=0.0)
    folder = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        run.run(docs, call, folder, settings)
    assert [(r["doc_id"], r["chunk_id"], r["error"]) for r in run.failures(spark, folder).collect()] == [(1, 1, "down")]
    assert run.utterances(spark, folder).count() == 6
    (tmp_path / "state").write_text("up")
    found = run.run(docs, call, folder, settings)
    assert sorted((r["doc_id"], r["chunk_id"], r["dialogue_index"], r["dialogue"]) for r in found.where("role = 'A'").collect()) == [(1, 0, 0, "good one"), (1, 1, 0, "bad two"), (1, 2, 0, "good three"), (2, 0, 0, "good four")]
    assert found.where("role = 'B' AND reply.target_index = 0 AND reply.target_chunk_id = chunk_id").count() == 4
    assert run.run(docs, call, folder, settings).count() == 8 and run.failures(spark, folder).count() == 0
    assert sorted(len(p.read_text()) for p in asked.iterdir()) == [1, 1, 1, 2]


def test_markers(spark, tmp_path):
    done = spark.createDataFrame([(0,), (2,), (2,)], "chunk_id long")
    for _ in range(2):
        resume.mark(done, str(tmp_path / "marker"))
    resume.mark(spark.createDataFrame([(2,), (5,)], "chunk_id long"), str(tmp_path / "marker"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "marker")).collect()) == ["0", "2", "5"]


def test_token_counts(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    text = "A first line of words.\nSecond line!\n" + "Long sentence? " * 9 + "\nend"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [r["chunk_text"] for r in segment.segment(docs, segment.token_counter(path), 14, 4).orderBy("chunk_id").collect()]
    assert got == segment.fold([x.strip() for x in text.splitlines()], count, 14, 4) and len(got) > 3
    assert [r[0] for r in docs.select(segment.count_column("text", segment.token_counter(path))).collect()] == [count(text), None]
    talk = spark.createDataFrame([(0, 0, "A", "one two"), (0, 1, "B", "three")], "chunk_id long, dialogue_index long, role string, dialogue string")
    assert stats.length_summary(talk, segment.count_column("dialogue", segment.token_counter(path))).first()["average_tokens"] == (count("one two") + count("three")) / 2


def test_extraction_retries_and_replays(spark):
    chunks = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "doc_id long, chunk_id long, chunk_text string")

    def call(chunk):
        if chunk == "bad":
            raise ValueError("no")
        return chunk.upper()

    found = extract.extract(chunks, call, 2, 2, 0.0)
    assert {r["chunk_id"]: (r["response"], r["status"], r["error"]) for r in found.collect()} == {0: ("GOOD", "ok", None), 1: (None, "failed", "no")}
    with pytest.raises(RuntimeError):
        resume.assert_complete(found)
    stored = found.where("status = 'ok'").select("doc_id", "chunk_id", "response")
    assert {r["chunk_id"]: r["status"] for r in extract.replay(chunks, stored).collect()} == {0: "ok", 1: "failed"}
    payload = spark.createDataFrame([('{"choices": [{"message": {"content": " hi "}}]}',), ("no json",)], "p string")
    assert [r[0] for r in payload.select(extract.response_text(F.col("p"))).collect()] == ["hi", None]


def test_resume(spark, tmp_path):
    ids = spark.createDataFrame([(0,), (1,), (3,)], "chunk_id long")
    assert resume.first_missing(ids).first()[0] == 2
    assert resume.first_missing(ids.where("chunk_id > 0")).first()[0] == 0
    assert [r[0] for r in resume.remaining(spark.range(5).withColumnRenamed("id", "chunk_id"), ids).orderBy("chunk_id").collect()] == [2, 4]
    spark.range(3).write.parquet(str(tmp_path / "in"))
    for n in (3, 5):
        resume.run_stream(spark, str(tmp_path / "in"), "id long", lambda d: d.selectExpr("id * 2 AS id"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "in"))


def test_settings(tmp_path):
    assert Settings.from_env({"CONVOFLOW_MAX_TOKENS": "50", "CONVOFLOW_COVER_TOKENS": "5"}).max_tokens == 50
    with pytest.raises(ValueError):
        Settings(max_tokens=10, cover_tokens=10)
    (tmp_path / ".env").write_text("# run\nexport CONVOFLOW_REPLY_WINDOW=0\nCONVOFLOW_REPLY_CONFIDENCE='7'\nCONVOFLOW_MAX_TOKENS=70\nCONVOFLOW_FAIL_ON_PARSE_ERROR=yes\n")
    found = Settings.from_file(str(tmp_path / ".env"), {"CONVOFLOW_MAX_TOKENS": "60", "CONVOFLOW_COVER_TOKENS": "6"})
    assert (found.reply_window, found.reply_confidence, found.max_tokens, found.fail_on_parse_error) == (1, 1.0, 60, True)
    assert [endpoint(*x) for x in (("openai", "gpt-4o-mini"), ("custom", "o3", "https://api.openai.com"), ("openai", "text-1"), ("custom", "gpt-4o"))] == ["responses", "responses", "chat", "chat"]


def test_response_text_is_the_first_of_any_output(spark):
    message = {"type": "message", "content": [{"type": "refusal"}, {"type": "output_text", "text": ""}, {"type": "output_text", "text": " yes "}, {"text": "later"}]}
    outputs = [[{"type": "reasoning"}, {"type": "tool", "content": None}, {"type": "reasoning", "content": []}, message], [message], [], [{"content": "no list"}, message]]
    payload = spark.createDataFrame([(i, json.dumps({"output": o})) for i, o in enumerate(outputs)], "i int, p string")
    assert [r[0] for r in payload.orderBy("i").select(extract.response_text(F.col("p"))).collect()] == ["yes", "yes", None, "yes"]
