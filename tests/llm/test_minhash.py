"""Near-duplicate detection by one-permutation hashing, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, documents

from convoflow.llm import common, minhash

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 2 else set(zip(w, w[1:]))


def brute(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in sets)


def found(docs):
    return sorted(tuple(r[c] for c in COLUMNS) for r in minhash.near_duplicates(docs).collect())


def test_near_duplicates(spark):
    rows = documents(160, 3)
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    assert found(docs) == brute(rows)
    names = ["class", "size", "label", "bucket", "hub", "text_a", "m", "_key0", "node", "buckets", "kept"]
    assert found(docs.withColumns({n: F.lit("x") for n in names})) == brute(rows)
    assert found(docs.where("doc_id < 0")) == []


@pytest.mark.parametrize("small", [60, 8, 2])
def test_a_bucket_of_unlike_members_loses_no_link(spark, monkeypatch, small):
    """Bands of one component: whatever shares a passage meets, most of it unlike the hub, with copies and a chain among it."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(5)
    own = lambda k: [f"w{rng.randint(0, 10**6)}" for _ in range(k)]
    shared = own(25)
    texts = [own(20) + shared for _ in range(30)]
    texts += [[*t[:-1], "other"] for t in texts[:12]] + [["new", *t] for t in texts[30:36]]
    step = own(60)
    texts += [[*step[: 60 - i], *(f"x{j}" for j in range(i))] + shared for i in range(0, 30, 3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in minhash.near_duplicates(docs, k=64, rows=1).collect())
    assert got == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (3, "A b  c"), (3, "a b c"), (None, None), (None, "x"), (None, "X"), (9, ""), (9, "")]
    got = sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())))
    assert got == sorted(map(str, [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True), (9, 0, 9, True)]))


def test_signatures():
    rng = np.random.default_rng(2)
    near = []
    for size in (1, 2, 7, 60, 900):
        union = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        whole = minhash.signature(union)
        assert len(whole) == minhash.BINS and set(whole.tolist()) <= set(union.tolist())
        near += [np.mean(whole == minhash.signature(np.sort(rng.choice(union, max(1, size * 4 // 5), replace=False)))) for _ in range(40 * (size > 7))]
    assert abs(np.mean(near) - 0.8) < 0.03  # agreement estimates the similarity, with and without empty bins


def test_pairs_at_the_threshold_meet():
    """4 of 5 shingles shared: of 3,000 pairs of sets of all sizes every one shares a bucket."""
    rng = np.random.default_rng(9)
    for i in range(3000):
        size = int(rng.integers(1, 60)) * 5 if i % 10 else 2000
        union = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        part = np.sort(rng.choice(union, len(union) * 4 // 5, replace=False))
        assert set(minhash.buckets(union)) & set(minhash.buckets(part))


def test_all_buckets_travel_once_and_a_hub_of_many_partners_is_spread(spark, monkeypatch):
    """Rows by class and bucket are joined with nothing, however large; links hold where partners of one hub lie in many places."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "PARTNERS", 4, raising=False)
    joined = []
    monkeypatch.setattr(minhash, "lookup", lambda rows, *x, **kw: joined.append(rows.count()) or common.lookup(rows, *x, **kw))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [[*base[:i], f"n{i}", *base[i + 1 :]] for i in range(0, 60, 2)] + [[f"u{rng.randint(0, 10**6)}" for _ in range(30)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    assert max(joined) < len(rows) * minhash.BINS // minhash.ROWS / 2
