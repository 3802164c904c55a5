"""Registered queries over whole tables, against brute force, where SQL cannot say what they return."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from convoflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def encoded(rows):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(path))
    return {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_mixing(spark, rows):
    found = {r["doc_id"]: r for r in QUERIES["op1_mixing"](spark, SF).collect()}
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    of = {r["doc_id"]: r["source"] for r in rows}
    total = Counter()
    for i, n in sizes.items():
        total[of[i]] += n
    names = sorted(x for x in total if x is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, target, budget = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= set(full)
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
    assert set(found) == set(sizes)
    taken = Counter()
    for i, r in found.items():
        assert (r["size"], r["source_size"]) == (sizes[i], total[of[i]]) and r["target"] == pytest.approx(target[of[i]])
        assert 0 <= r["taken"] <= 2 * sizes[i] and r["taken"] % max(1, sizes[i]) == 0
        taken[of[i]] += r["taken"]
    for s in names:  # as near as documents taken once more, besides whole rounds, can come
        whole = int(target[s] // total[s]) * total[s]
        sums = 1
        for i, n in sizes.items():
            sums |= sums << n if of[i] == s else 0
        best = min(abs(whole + k - target[s]) for k in range(total[s] + 1) if sums >> k & 1)
        assert abs(taken[s] - target[s]) == pytest.approx(best)


def test_token_shards(spark, encoded):
    start, want = 0, []
    for i in sorted(encoded):
        want.append((i, start, len(encoded[i]), crc(encoded[i])))
        start += len(encoded[i])
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op5_token_shards"](spark, SF).collect())
    assert got == want


def test_packing(spark, encoded):
    pieces, bins = {}, {}
    for r in QUERIES["op9_packing"](spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(encoded)
    for i, found in pieces.items():
        found.sort(key=lambda r: r["piece"])
        at = 0
        assert [r["piece"] for r in found] == list(range(len(found)))
        for r in found:
            assert r["start"] == at and r["ids_crc32"] == crc(encoded[i][at : at + r["length"]])
            at += r["length"]
        assert at == len(encoded[i]) and (len(found) == 1 if at <= 1024 else all(r["length"] == 1024 for r in found[1:]))
    for found in bins.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    # Never above plain best fit over the same pieces.
    free: list[int] = []
    for n in sorted((r["length"] for f in pieces.values() for r in f), reverse=True):
        fits = [k for k, room in enumerate(free) if room >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(1024 - n)
    assert math.ceil(sum(map(len, encoded.values())) / 1024) <= len(bins) <= len(free)


def test_scores(spark, rows):
    tokens = {r["doc_id"]: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split(), None] for r in rows}
    counts = Counter(t for i, found in tokens.items() if remainder(i) != 1 for t in found)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in QUERIES["op10_lm_scores"](spark, SF).collect()}
    assert set(got) == set(tokens)
    held = [0.0, 0.0]
    for i, found in tokens.items():
        r = got[i]
        base = math.fsum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in found)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i) == 1, len(found), sum(counts[t] > 0 for t in found), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        if r["held_out"]:
            held[0] += r["score"]
            held[1] += r["base_score"]
    assert held[0] > held[1]  # the mixture says more of texts that it has not seen than the base does
