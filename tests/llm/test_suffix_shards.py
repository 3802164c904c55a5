"""What of suffix de-duplication goes to the suffix array, and what comes of the rest."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from convoflow.llm import suffix


def test_pieces_that_meet_no_other_are_not_sorted(monkeypatch):
    """Pieces that share no window with others of their route are repeats by their number; those that meet, and heavy ones, are sorted."""
    sorted_pieces = []
    real = suffix.repeats

    def watched(pieces, counts, length):
        sorted_pieces.extend(pieces)
        return real(pieces, counts, length)

    monkeypatch.setattr(suffix, "repeats", watched)
    rng = random.Random(4)
    piece = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    alone, once, own = piece(230), piece(240), piece(210)
    shared = piece(205)
    left, right = piece(30) + shared, shared + piece(20)
    gram = shared[100:148]  # that all pieces of route 3 hold
    near = piece(110) + gram + piece(60)
    rows = [(1, b"a", 1, alone, 50), (1, b"a", 2, alone, 50), (2, b"b", 1, once, 60), (3, b"l", 1, left, 130), (3, b"n", 1, near, 110), (3, b"r", 1, right, 100), (4, b"o", 2, own, 9), (5, b"p", 2, own, -1), (5, b"q", 1, once, -1)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["least", "digest", "n", "piece", "at"])
    for batches in ([batch], [batch[i : i + 1] for i in range(len(rows))]):
        for shard_bytes in (1, 1 << 20):
            sorted_pieces.clear()
            found = [out.to_pydict() for out in suffix._sorted_shards(200, shard_bytes)(iter(batches))]
            spans = {d: np.frombuffer(s, "<i4").tolist() for out in found for d, s in zip(out["digest"], out["spans"], strict=True)}
            assert spans == {b"a": [0, 31], b"l": [30, 36], b"r": [0, 6], b"o": [0, 11], b"p": [0, 11]}
            assert sorted(sorted_pieces) == sorted([left, right, own, once])


def test_pieces_meet_wherever_windows_are_equal():
    rng = random.Random(6)
    letters = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    passage = letters(900)
    texts = []
    for _ in range(60):
        a = rng.randrange(600)
        texts.append(letters(rng.randrange(120)) + passage[a : a + rng.randrange(190, 300)] + letters(rng.randrange(120)))
    routes = {}
    for text in texts:
        edges, least, places = suffix.minimizer_runs(np.frombuffer(text, np.uint8), 200, suffix.GRAM)
        for j, route in enumerate(least.tolist()):
            routes.setdefault(route, {})[text[edges[j] : edges[j + 1] + 199]] = int(places[j] - edges[j])
    apart = together = 0
    for held in routes.values():
        pieces = list(held)
        windows = [{p[i : i + 200] for i in range(len(p) - 199)} for p in pieces]
        for i, meets in enumerate(suffix.meetings(pieces, list(held.values()), 200)):
            shares = any(windows[i] & w for j, w in enumerate(windows) if j != i)
            assert meets or not shares
            together += shares
            apart += len(pieces) > 1 and not meets
    assert together > 50 and apart > 5
