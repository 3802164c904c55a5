"""Source divergence and phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, documents

from convoflow.llm import collocations, divergence

# ---- source divergence -------------------------------------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_divergence(rows, least=10, top=10):
    counts, seen, groups = {}, {}, set()
    for _, text, lang, source, *_ in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        counts.setdefault(key, Counter()).update(found)
        seen.setdefault(key[0], Counter()).update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        of = {s: [counts[lang, s][t] for t in kept] for s in sources}
        share = lambda n: [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n]
        p = {s: share(of[s]) for s in sources}
        q = share([sum(x) for x in zip(*of.values())]) if kept else []
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s))
            found = sorted((-f(a, b), t.encode()) for a, b, t, n in zip(p[s], q, kept, of[s]) if n and a > b)[:top]
            for part, ranked in (("pair", pairs), ("term", found)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def diverged(docs, **settings):
    rows = [tuple(r[c] for c in COLUMNS) for r in divergence.source_divergence(docs, **settings).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("stripe", "cell"), [(4096, 4), (7, 1), (40, 2)])
def test_divergence(spark, stripe, cell):
    rng = random.Random(8)
    rows = [(i, (t or "") + " Straße ÉTÉ aB_cd" * (i % 3) if t is not None else None, rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "ü", "", None, "x1", "x2", "x3", "x4"]), 0, "c") for i, t, *_ in documents(220, 4)]
    rows += [(1000 + i, None, "xx", f"y{i % 3}", 0, "c") for i in range(5)] + [(2000, "lone word", "yy", "only", 0, "c")] * 12
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    names = ["term", "n", "stripe", "host", "round", "blob", "total", "cell", "item", "value", "rank", "v", "all"]
    found = diverged(docs.withColumns({n: F.lit("x") for n in names}), stripe_terms=stripe, cell=cell)
    assert found == brute_divergence(rows)
    assert {r[4] for r in found if r[0] == "xx"} == {0} and ("yy", "only", "term", "lone", 0, 1) not in found
    assert diverged(docs.where("doc_id < 0")) == set()


@pytest.mark.parametrize("cells", [1, 2, 3, 4, 7, 10])
def test_each_two_cells_meet_once(spark, cells):
    rows = spark.range(cells).select(F.col("id").cast("int").alias("c"), divergence.visits(F.col("id").cast("int"), F.lit(cells)).alias("v")).collect()
    meetings = [(tuple(sorted((r["c"], v["host"]))), v["round"]) for r in rows for v in r["v"]]
    assert Counter(m for m, _ in meetings) == Counter((a, b) for a in range(cells) for b in range(a + 1, cells))
    for round_ in range(cells):
        busy = [c for m, r in meetings if r == round_ for c in m]
        assert len(busy) == len(set(busy))  # nobody meets two in one round


def test_shares_are_exact_for_large_counts():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randint(3, 9 * 10**15)
        n = rng.randint(0, total - 2)
        assert divergence.share(np.array([n]), total)[0] == 1 + 10**9 * (n + 2) // total


def test_terms_come_in_stretches():
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "É", " ", "7", "Z", "_", "longer"]) for _ in range(2000)).encode()
    whole = [t for part in divergence.terms(text) for t in part]
    for stretch in (1, 3, 17, 500):
        assert [t for part in divergence.terms(text, stretch) for t in part] == whole
    assert list(divergence.terms(b"")) == []


# ---- collocations ------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, top, depth=5):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, depth + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        ranked = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(x) > len(p) and b >= a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def phrases(n=150):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["Ünit", "x\x00y", "it's", "日本"]
    set_phrases = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(set_phrases) if rng.random() < 0.4 else rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "\t ", ", ", ".", "\n", "\r\n", "\x0b"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "", "und"]), "s", 0, "c"))
    return rows + [(n, None, "en", "s", 0, "c"), (n + 1, "", "fr", "s", 0, "c"), (n + 2, " aa bb cc dd ee ff" * 400, "en", "s", 0, "c"), (n + 3, "aa bb," * 30, "only", "s", 0, "c")]


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_WORDS", 300), ("HELD", 30), ("FAN_IN", 2), ("SHARDS_A_TASK", 3), ("RANGE_WORDS", 60), ("BOUND_WORDS", 30)):
            monkeypatch.setattr(collocations, name, value)
    rows = phrases()
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    names = ["phrase", "word", "n", "a", "l", "r", "score", "rank", "link", "first", "trie", "k", "m"]
    for least, top in ((8, 1000), (25, 7)):
        found = collocations.collocations(docs.withColumns({n: F.lit("x") for n in names}), least=least, top=top)
        assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in found.collect()) == brute_collocations(rows, least, top)
    assert collocations.collocations(docs.where("doc_id < 0")).count() == 0


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "frequency_sketch", lambda first: np.full(1 << collocations.SKETCH_BITS, 65535, np.uint16))
    rows = phrases(60)
    found = collocations.collocations(spark.createDataFrame(rows, DOC).repartition(3), least=12)
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in found.collect()) == brute_collocations(rows, 12, 2000)


def test_scores_do_not_overflow(spark):
    rows = [(i, "a b. " * 50_000, "en", "s", 0, "c") for i in range(4)]
    row = collocations.collocations(spark.createDataFrame(rows, DOC)).first()
    assert (row["a"], row["n"], row["score"]) == (200_000, 400_000, 1000 * 200_000 * 400_000 // 200_000**2)


def test_tries_merge():
    rng = random.Random(1)
    runs, total = [], Counter()
    for _ in range(5):
        counts = Counter((b"r", *(rng.choice([b"a", b"ab", b"b"]) for _ in range(k)))[: rng.randint(1, 4)] for k in (3,) for _ in range(30))
        for path in list(counts):
            for i in range(1, len(path)):
                counts.setdefault(path[:i], 1)
        runs.append(collocations.write_trie(sorted(counts.items())))
        total.update(counts)
    assert collocations.merged([list(collocations.read_trie(r)) for r in runs]) == sorted(total.items())
