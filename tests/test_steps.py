"""The command line on files, and the listener of a run."""

from __future__ import annotations

import json

import pytest
from test_operators import utterance

from convoflow.__main__ import main
from convoflow.config import Settings
from convoflow.streaming import run
from convoflow.streaming.listen import Waves, listening


@pytest.fixture
def files(tmp_path):
    """Two books that number their chunks alike."""
    for book, turns in (("a", 3), ("b", 2)):
        lines = [utterance(index=i, role="XY"[i % 2], dialogue=f"{book}{i}", reply={"target_index": i - 1, "target_role": "XY"[(i - 1) % 2], "confidence": 0.9} if i else None) for i in range(turns)]
        (tmp_path / f"{book}.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return tmp_path


def read(spark, path):
    return [json.loads(r[0]) for r in spark.read.option("recursiveFileLookup", True).text(str(path)).collect()]


def test_validation(spark, files, capsys):
    assert main(["validate", str(files), "--copy", f"{files}/copy"], spark) == 0
    assert len(read(spark, files / "copy")) == 5
    (files / "b.jsonl").write_text('{"a":\n', encoding="utf-8")
    assert main(["validate", str(files), "--errors", f"{files}/errors", "--copy", f"{files}/none"], spark) == 1
    assert sorted(r["code"] for r in read(spark, files / "errors")) == ["E_EMPTY", "E_JSON"] and not (files / "none").exists()
    assert "E_JSON\t1" in capsys.readouterr().out
    with pytest.raises(SystemExit), pytest.warns(UserWarning):
        main(["validate", f"{files}/nothing"], spark)


def test_pairs_and_chat(spark, files, capsys):
    assert main(["pairs", str(files), "--strict", "--out", f"{files}/pairs"], spark) == 0
    found = read(spark, files / "pairs")
    assert sorted((p["source"]["text"], p["reply"]["text"]) for p in found) == [("a0", "a1"), ("a1", "a2"), ("b0", "b1")]
    assert main(["pairs", str(files), "--pair", "ALL,X", "--merge", f"{files}/merged"], spark) == 0
    assert [p["reply"]["text"] for p in read(spark, files / "merged")] == ["a2"]
    capsys.readouterr()
    assert main(["pairs", f"{files}/a.jsonl", "--pair", "ALL", "--list"], spark) == 0
    assert capsys.readouterr().out.split() == ["X", "Y", "1", "Y", "X", "1"]
    assert main(["chat", f"{files}/merged", "--out", f"{files}/chat", "--system", "be brief", "--meta"], spark) == 0
    record = read(spark, files / "chat")[0]
    assert [m["content"] for m in record["messages"]] == ["be brief", "a1", "a2"] and record["meta"]["pair"] == {"from": "Y", "to": "X"}
    (files / "a.jsonl").write_text(utterance(role=""), encoding="utf-8")
    assert main(["pairs", str(files), "--validate", "--list"], spark) == 3
    with pytest.raises(SystemExit):
        main(["pairs", str(files)], spark)


def test_statistics_sorting_and_filters(spark, files, capsys):
    assert main(["stats", str(files), "--out", f"{files}/stats"], spark) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 5
    assert sorted(r["dialogues"] for r in read(spark, files / "stats" / "chunks")) == [2, 3]
    assert main(["sort", f"{files}/a.jsonl", "--out", f"{files}/sorted"], spark) == 0
    assert [r["dialogue"] for r in read(spark, files / "sorted")] == ["a0", "a1", "a2"]
    assert main(["filter", f"{files}/a.jsonl", "--chunks", "4,5", "--out", f"{files}/some"], spark) == 0
    assert read(spark, files / "some") == []


def test_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("abc\ndefg\nhij\nklmnop", encoding="utf-8")
    assert main(["segment", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--max-tokens", "10", "--cover-tokens", "4"], spark) == 0
    assert [r["chunk_text"] for r in read(spark, tmp_path / "out")] == ["abc\ndefg", "defg\nhij", "hij\nklmnop"]


def test_a_listener_hears_of_each_wave(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} ..." for i in range(4)))], "doc_id long, text string")
    told = []
    settings = Settings(max_tokens=12, cover_tokens=0, max_retries=1, retry_delay=0.0, parallelism=1, wave_chunks=1)
    with listening(spark, Waves(4, told.append)) as waves:
        run.run(docs, lambda chunk: "[]", str(tmp_path / "out"), settings)
    assert [w["processed"] for w in waves.waves] == [1, 2, 3, 4] and told == waves.waves and waves.ended >= 1
    assert all(w["speed_cps"] > 0 for w in told) and told[-1]["eta_sec"] == 0
