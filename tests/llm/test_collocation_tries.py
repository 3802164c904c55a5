"""Work on collocations that must not grow faster than the texts: what the tries hold, how they are dealt and merged."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from convoflow.llm import collocations

LONG = b"x" * 300


def texts(n=200):
    rng = random.Random(5)
    vocabulary = [b"w%d" % i for i in range(60)] + [LONG, "日本".encode(), b"a\x00b"]
    return [b" ".join(rng.choice([b"the", b"the", rng.choice(vocabulary), b"of the " + rng.choice(vocabulary[:4])]) + rng.choice([b"", b"", b"", b",", b".\n"]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def counted(rows, depth):
    found = Counter()
    for row in rows:
        for piece in row.replace(b"\n", b".").replace(b",", b".").split(b"."):
            words = piece.split()
            found.update(tuple(words[i : i + m]) for m in range(1, depth + 1) for i in range(len(words) - m + 1))
    return found


def batches(rows, size=40):
    return iter([pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows[i : i + size])), pa.array(rows[i : i + size], pa.binary())], ["lang", "text"]) for i in range(0, len(rows), size)])


def first_pass(rows, most_words=400, most_bytes=1 << 20):
    found = pa.Table.from_batches(collocations._first_pass(most_words, most_bytes)(batches(rows))).to_pylist()
    shards = [r for r in found if r["block"] == -1]
    return shards, Counter(), [r for r in found if r["block"] is None]


def shard_batches(shards):
    return iter([pa.RecordBatch.from_arrays([pa.array([r["lang"] for r in shards]), pa.array([r["shard"] for r in shards], pa.binary())], ["lang", "shard"])])


@pytest.mark.parametrize("limits", [(400, 1 << 20), (1 << 20, 700), (1 << 30, 1 << 30)])
def test_shards_hold_all_words_once(limits):
    rows = texts()
    shards, total, words = first_pass(rows, *limits)
    for r in words:
        total[(r["word"],)] += r["n"]
    assert total == Counter({p: n for p, n in counted(rows, 1).items()}) and (len(shards) > 3) == (limits[0] < 1 << 30)


def test_pieces_are_cut_alike_in_any_stretch():
    text = b"Ab\tC, d.e \xc3\x89! " * 50 + b"y" * 200 + b" z"
    whole = b"".join(collocations.stretches(text))
    for stretch in (1, 3, 17, 500):
        parts = list(collocations.stretches(text, stretch))
        assert b"".join(parts) == whole and all(p.endswith(b"\xff") for p in parts[:-1])


def test_only_frequent_pairs_reach_the_tries_though_the_sketch_is_full(spark):
    rows, least = texts(), 40
    shards, _, _ = first_pass(rows)
    full = SimpleNamespace(value=np.full(1 << collocations.SKETCH_BITS, 65535, np.uint16))
    frame = spark.createDataFrame([("en", bytearray(r["shard"])) for r in shards], "lang string, shard binary").repartition(3)
    bitmap = SimpleNamespace(value=collocations.pair_bitmap(frame, full, least, 7))
    true = counted(rows, 5)
    frequent = {p for p, n in true.items() if len(p) == 2 and n >= least}
    assert 5 < len(frequent) < sum(len(p) == 2 for p in true) / 4 and np.unpackbits(bitmap.value).sum() == len(frequent)
    bounds = SimpleNamespace(value={"en": collocations.Bounds([b"of", b"w3"], {b"the": (3, 4)})})
    parts = [r for b in collocations._tries(bitmap, bounds, 5)(shard_batches(shards)) for r in b.to_pylist()]
    found, ranges = Counter(), {}
    for r in parts:
        for path, n in collocations.read_trie(r["trie"]):
            if len(path) > 1:
                found[path] += n
                assert ranges.setdefault(path, r["prefix"]) == r["prefix"]
    runs = lambda p: all(p[i : i + 2] in frequent for i in range(len(p) - 1))
    assert found == Counter({p: n for p, n in true.items() if len(p) > 1 and runs(p)})
    # A heavy first word is dealt by the second: one task does not get it whole.
    assert len({prefix for path, prefix in ranges.items() if path[0] == b"the"}) > 1
    assert all((prefix > 2) == (path[0] == b"the") for path, prefix in ranges.items())


def test_parts_of_a_range_are_merged_a_few_times_each(monkeypatch):
    rng = random.Random(2)
    merged, work, total, rows = collocations.merged_tries, [], Counter(), []
    monkeypatch.setattr(collocations, "NODES", 50)
    monkeypatch.setattr(collocations, "FAN_IN", 4)
    monkeypatch.setattr(collocations, "merged_tries", lambda tries: work.append(sum(t.size() for t in tries)) or merged(tries))
    for i in range(300):
        nodes = Counter({(b"r", b"%d" % i, b"%d" % rng.randrange(9)): 1 for _ in range(5)} | {(b"r", b"s"): 2})
        nodes.update({(b"r",): 0, (b"r", b"%d" % i): 1})
        nodes = {p: nodes[p] for p in sorted(nodes)}
        total.update({p: n for p, n in nodes.items()})
        rows.append(collocations.write_trie(sorted(nodes.items())))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), pa.array([0] * 300, pa.int32()), pa.array(rows, pa.binary())], ["lang", "prefix", "trie"])
    ((key, trie),) = collocations._merged_prefixes(iter([batch]))
    found = {path: counts[-1] for path, counts in collocations.paths(trie)}
    assert key == ("en", 0) and found == {p: total[p] for p in found} and len(found) == len(total)
    # All nodes are unlike, so a running merge would meet the first ones some seventy times.
    assert sum(work) < 12 * len(total)
    assert {p: c for p, c in collocations.paths(trie, 2) if len(p) > 1} == {(b"r", b"s"): [0, 600]}


def test_heavy_words_have_ranges_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_WORDS", 100)
    rows = [("en", b"w%03d" % i, 30) for i in range(40)] + [("en", b"the", 950), ("en", b"rare", 3), ("de", b"a", 50)]
    found = collocations.prefix_bounds(spark.createDataFrame([(a, bytearray(w), n) for a, w, n in rows], "lang string, word binary, n long"), 10)
    assert set(found) == {"en"} and found["en"].heavy == {b"the": (len(found["en"].starts) + 1, 10)} and 5 <= len(found["en"].starts) <= 12


def test_short_pieces_and_many_languages_fill_shards_too():
    rows = [b"a.b,c d." * 200] * 3
    shards = [s for b in [batches(rows)] for s in collocations._shards(b, 500, 1 << 20)]
    assert len(shards) >= 3 and all(len(s.x) < 2500 for s in shards)
    langs = [f"l{i % 50}" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array([b"one two three"] * 400, pa.binary())], ["lang", "text"])
    shards = list(collocations._shards(iter([batch]), 1 << 20, 1000))
    assert 50 < len(shards) < 300 and sum((s.x > 0).sum() for s in shards) == 1200
