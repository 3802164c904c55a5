"""Phrase collocations by depth-limited count tries.

A first pass cuts the texts into shards of about SHARD_WORDS words, stored as numbers, and counts words, and adjacent pairs in a
sketch of fixed size. Pairs that the sketch does not call rare are then counted exactly by their hashes, a range of hashes in a
task; a bitmap of fixed size tells the frequent ones. Neither ever counts too little, so no frequent phrase runs across a pair
that they clear, and where they are full they only clear less. A last pass builds a trie of what is left of each shard: level by
level, a node is its parent and a word, and nodes are numbered in the order of their phrases. A shard's trie is serialised
sorted, cut where prefix ranges of first words end (a heavy first word is dealt by the second), and the parts of a range are
merged k ways, level by level; the paths of a merged trie have the left parts of every cut. The right parts come along suffix
links: a phrase without its first word is a node one level up, which has its own right parts already.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, lookup, small_batches, stored, table, tidy
from .jaccard import SKETCH_BITS, SKETCH_BLOCKS, frequency_sketch

#: Fixed values of the contract: words of a phrase, occurrences of a candidate, factor of a score, phrases reported a language.
DEPTH, LEAST, FACTOR, TOP = 5, 100, 1000, 2000
#: Words and breaks of a shard, and bytes of text that a task holds in all its shards.
SHARD_WORDS, HELD = 2_000_000, 24 << 20
#: Bits of a pair's hash by which it is counted, bits that address the bitmap of frequent pairs (16 MB), pairs that a task counts at a time, about.
PAIR_BITS, BITMAP_BITS, PAIRS_A_RANGE = 36, 27, 8_000_000
#: Parts of at least so many, and nodes, that are merged at a time, and parts of one prefix range that one task merges.
FAN_IN, NODES, SHARDS_A_TASK = 64, 1_000_000, 16_384
#: Words of a prefix range, about, and ranges at most; frequent words that their bounds are taken from. Bounds only route.
RANGE_WORDS, RANGES, BOUND_WORDS = 2_000_000, 4096, 200_000
#: Words up to this many bytes are hashed together.
_SHORT = 64
_BREAK = b"\xff"  # no UTF-8 text has it
_PIECES = bytes.maketrans(bytes(range(0x41, 0x5B)) + b"\x09.,;:!?\x0a\x0b\x0c\x0d", bytes(range(0x61, 0x7B)) + b" " + _BREAK * 10)


def stretches(text: bytes, stretch: int = 1 << 20) -> Iterator[bytes]:
    """A text lower-cased, with a break between pieces: a stretch of whole pieces at a time."""
    at = 0
    while at < len(text):
        end = at + stretch
        parts = [text[at:end].translate(_PIECES)]
        while end < len(text) and _BREAK not in parts[-1]:
            parts.append(text[end : end + stretch].translate(_PIECES))
            end += stretch
        part = b"".join(parts)
        if end < len(text):
            part = part[: part.rfind(_BREAK) + 1]
        yield part
        at += len(part)


def numbered(text: bytes) -> tuple[np.ndarray, pa.BinaryArray]:
    """Stretches -> their words as numbers in the order of pieces, 0 for breaks, and the words from number 1 on."""
    raw = np.frombuffer((_BREAK + text).replace(_BREAK, b" \xff "), np.uint8)
    keep = raw != 0x20
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    data = raw[keep]
    ends = np.append(np.flatnonzero(start[keep]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    x = words.indices.to_numpy()
    return x[np.append(True, (x[1:] > 0) | (x[:-1] > 0))], words.dictionary[1:]


def _lengths(words: pa.BinaryArray) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(words: pa.BinaryArray) -> np.ndarray:
    """The bytes of all words, one behind the other."""
    if not len(words):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _words(lengths: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def word_hashes(words: pa.BinaryArray, lang: str) -> np.ndarray:
    """64-bit hashes, of words of a language. Unlike words may share one: it only routes and clears."""
    lengths = _lengths(words)
    short = lengths <= _SHORT
    found = np.zeros(len(words), np.uint64)
    some = words.filter(pa.array(short))
    if len(some):
        data, size = _joined(some), lengths[short]
        starts = np.cumsum(size) - size
        powers = np.cumprod(np.full(_SHORT, 0x9E3779B97F4A7C15, np.uint64))
        found[short] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, size)], starts)
    for i in np.flatnonzero(~short):
        found[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    found ^= np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        found = (found ^ found >> np.uint64(33)) * np.uint64(factor)
    return found ^ found >> np.uint64(33)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, compressed, each by the width that it needs."""
    parts = []
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << 8 * w)
        parts += [struct.pack("<BI", width, len(a)), a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]
    return zlib.compress(b"".join(parts), 1)


def unpacked(data: bytes, text: int = -1) -> list[np.ndarray]:
    """The arrays as 64-bit numbers, but the one at `text`, which are bytes."""
    raw, at, found = zlib.decompress(data), 0, []
    while at < len(raw):
        width, n = struct.unpack_from("<BI", raw, at)
        planes = np.frombuffer(raw, np.uint8, width * n, at + 5).reshape(width, n)
        found.append(planes[0] if len(found) == text else np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 5 + width * n
    return found


class _Shard(NamedTuple):
    """Words of one language as numbers, 0 between documents and pieces, and what the other numbers mean."""

    lang: str
    x: np.ndarray
    words: pa.BinaryArray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The places where two words stand side by side, and the pairs' hashes."""
        at = np.flatnonzero((self.x[:-1] > 0) & (self.x[1:] > 0))
        hashes = np.append(np.zeros(1, np.uint64), word_hashes(self.words, self.lang))
        mixed = (hashes[self.x[at]] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[self.x[at + 1]]) * np.uint64(0xBF58476D1CE4E5B9)
        return at, mixed ^ mixed << np.uint64(32)


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], most_words: int, most_bytes: int) -> Iterator[_Shard]:
    """The shards of a partition's (lang, text: binary), each handed on when it is full, the largest ones when all hold too much."""
    held: dict[str, list] = {}  # parts, words about, bytes
    total = 0

    def taken(lang: str) -> _Shard:
        nonlocal total
        parts, _, size = held.pop(lang)
        total -= size
        return _Shard(lang, *numbered(_BREAK.join(parts)))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in stretches(text.as_py()):
                mine = held.setdefault(lang, [[], 0, 0])
                mine[0].append(part)
                mine[1] += part.count(b" ") + part.count(_BREAK) + 1
                mine[2] += len(part) + 1
                total += len(part) + 1
                if mine[1] > most_words:
                    yield taken(lang)
                elif total > most_bytes:
                    for name in sorted(held, key=lambda name: -held[name][2]):
                        if total > most_bytes // 2:
                            yield taken(name)
    while held:
        yield taken(next(iter(held)))


_FIRST = {"lang": pa.string(), "word": pa.binary(), "n": pa.int64(), "block": pa.int32(), "counts": pa.binary(), "shard": pa.binary()}


def _first_rows(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(rows, kind)) for name, kind in _FIRST.items()], list(_FIRST))


def _first_pass(most_words: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, word, n in rows without a block, lang, shard in those of block -1, and the task's sketch of pairs in the others."""
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for shard in _shards(batches, most_words, most_bytes):
            if not len(shard.words):
                continue
            _, pair = shard.pairs()
            at, counts = np.unique(_top(pair, SKETCH_BITS), return_counts=True)
            sketch[at] += counts.astype(np.uint32)
            del pair, at, counts
            n = np.bincount(shard.x, minlength=len(shard.words) + 1)[1:]
            yield _first_rows(len(n), lang=pa.array([shard.lang]).take(pa.array(np.zeros(len(n), np.int8))), word=shard.words, n=pa.array(n, pa.int64()))
            # Frequent words have small numbers.
            order = np.argsort(-n, kind="stable")
            place = np.zeros(len(n) + 1, np.int64)
            place[order + 1] = np.arange(1, len(n) + 1)
            words = shard.words.take(pa.array(order))
            row = packed(place[shard.x], _lengths(words), _joined(words))
            yield _first_rows(1, lang=pa.array([shard.lang]), block=pa.array([-1], pa.int32()), shard=pa.array([row], pa.binary()))
            tidy()
        for block, part in enumerate(np.split(np.minimum(sketch, 65535).astype("<u2"), SKETCH_BLOCKS)):
            if part.any():
                yield _first_rows(1, block=pa.array([block], pa.int32()), counts=pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()))
        del sketch, part
        tidy()

    return run


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    for batch in batches:
        for lang, shard in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x, lengths, data = unpacked(shard.as_py(), 2)
            yield _Shard(lang, x, _words(lengths, data))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


_PAIRS = {"part": pa.int32(), "pairs": pa.binary()}


def _pairs(sketch, least: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, pairs: the hashes of a shard's pairs that the sketch does not call rare, by ranges of hashes, and their counts."""
        starts = (np.arange(parts, dtype=np.int64) << PAIR_BITS) // parts

        def found() -> Iterator[tuple]:
            for shard in _read_shards(batches):
                _, pair = shard.pairs()
                pair = pair[sketch.value[_top(pair, SKETCH_BITS)] >= min(least, 65535)]
                keys, counts = np.unique(_top(pair, PAIR_BITS), return_counts=True)
                cuts = np.append(np.searchsorted(keys, starts), len(keys))
                for part in np.flatnonzero(np.diff(cuts)):
                    mine = slice(cuts[part], cuts[part + 1])
                    yield int(part), packed(np.diff(keys[mine], prepend=0), counts[mine])
                tidy()

        yield from _rows(found(), _PAIRS)

    return run


def _frequent_pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bits: the places of frequent pairs in the bitmap. Rows come sorted by part."""

        def found() -> Iterator[tuple]:
            for _, rows in groupby(_values(batches), key=lambda row: row[0]):
                keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
                for _, pairs in rows:
                    steps, n = unpacked(pairs)
                    waiting.append((np.cumsum(steps), n))
                    size += len(n)
                    if size > max(NODES, len(keys)):
                        keys, counts = _added(*(np.concatenate(c) for c in zip((keys, counts), *waiting, strict=True)))
                        waiting, size = [], 0
                keys, counts = _added(*(np.concatenate(c) for c in zip((keys, counts), *waiting, strict=True)))
                bits = np.unique(keys[counts >= least] >> (PAIR_BITS - BITMAP_BITS))
                if len(bits):
                    yield (packed(np.diff(bits, prepend=0)),)

        yield from _rows(found(), {"bits": pa.binary()})

    return run


def pair_bitmap(shards: DataFrame, sketch, least: int, parts: int) -> np.ndarray:
    """A bit for each value that the leading BITMAP_BITS of a frequent pair's hash have, eight a byte."""
    pairs = shards.mapInArrow(_pairs(sketch, least, parts), "part int, pairs binary").repartition("part").sortWithinPartitions("part")
    bitmap = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for row in pairs.mapInArrow(_frequent_pairs(least), "bits binary").collect():
        bits = np.cumsum(unpacked(row["bits"])[0])
        np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    return bitmap


#: Nodes of a level in the order of their phrases: their places in the level above, their words' places, their counts.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


class Trie(NamedTuple):
    """Sorted words, and levels from the first words on. First words are counted elsewhere, and may have 0 here."""

    words: pa.BinaryArray
    levels: list[Level]

    def size(self) -> int:
        return sum(len(words) for _, words, _ in self.levels)


#: A node of a trie: its words, and its count.
Node = tuple[tuple[bytes, ...], int]


def count_trie(x: np.ndarray, at: np.ndarray, words: pa.BinaryArray, depth: int) -> Trie:
    """Numbers of words (0: a break) -> the trie of phrases that run over the pairs that start at some places."""
    pair = np.zeros(len(x) + depth, bool)
    pair[at] = True
    used = np.zeros(len(words) + 1, bool)
    used[x[at]] = used[x[at + 1]] = True
    numbers = np.flatnonzero(used)
    names = words.take(pa.array(numbers - 1))
    order = pc.sort_indices(names).to_numpy()
    numbers = numbers[order]
    rank = np.zeros(len(words) + 1, np.int64)
    rank[numbers] = np.arange(len(numbers))
    first, node = np.unique(rank[x[at]], return_inverse=True)
    levels: list[Level] = [(np.zeros(len(first), np.int64), first, np.zeros(len(first), np.int64))]
    for level in range(2, depth + 1):
        if level > 2:
            goes_on = pair[at + level - 2]
            node, at = node[goes_on], at[goes_on]
        found, node, counts = np.unique(node * max(1, len(numbers)) + rank[x[at + level - 1]], return_inverse=True, return_counts=True)
        levels.append(tuple(a.astype(np.int32) for a in (*divmod(found, max(1, len(numbers))), counts)))
    return Trie(names.take(pa.array(order)), levels)


def dump_trie(trie: Trie) -> bytes:
    children = [np.bincount(level[0], minlength=len(above[0])) for above, level in zip(trie.levels, trie.levels[1:])]
    return packed(_lengths(trie.words), _joined(trie.words), trie.levels[0][1], trie.levels[0][2], *(a for c, (_, words, counts) in zip(children, trie.levels[1:], strict=True) for a in (c, words, counts)))


def load_trie(data: bytes) -> Trie:
    lengths, names, words, counts, *rest = unpacked(data, 1)
    levels = [(np.zeros(len(words), np.int64), words, counts)]
    for children, words, counts in zip(*(rest[i::3] for i in range(3)), strict=True):
        levels.append((np.repeat(np.arange(len(children)), children), words, counts))
    return Trie(_words(lengths, names), levels)


def cut_trie(trie: Trie, first: np.ndarray, ranges: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, Trie]]:
    """Prefix ranges and the sub-tries that belong there: from first on, for each first word, as many as ranges says, dealt by the second word's hash."""
    parts, orders, levels = [], [], []
    for level, (parents, words, counts) in enumerate(trie.levels[1:]):
        if not level:
            part = (first[parents] + (hashes[words] % ranges[parents]).astype(np.int64)).astype(np.int32)
        else:
            part = parts[-1][parents]
        order = np.argsort(part, kind="stable")
        if orders:
            place = np.empty(len(orders[-1]), np.int32)
            place[orders[-1]] = np.arange(len(place))
            parents = place[parents]
            del place
        parts.append(part)
        orders.append(order)
        levels.append((parents[order], words[order], counts[order]))
    found = np.unique(parts[0])
    cuts = [np.append(np.searchsorted(part[order], found), len(part)) for part, order in zip(parts, orders, strict=True)]
    for i, name in enumerate(found.tolist()):
        mine = [tuple(a[c[i] : c[i + 1]] for a in level) for level, c in zip(levels, cuts, strict=True)]
        roots, above = np.unique(mine[0][0], return_inverse=True)
        mine = [(np.zeros(len(roots), np.int64), trie.levels[0][1][roots], trie.levels[0][2][roots]), (above, *mine[0][1:])] + [(p - c[i], w, n) for (p, w, n), c in zip(mine[1:], cuts, strict=False)]
        used, places = np.unique(np.concatenate([words for _, words, _ in mine]), return_inverse=True)
        places = np.split(places, np.cumsum([len(words) for _, words, _ in mine])[:-1])
        yield name, Trie(trie.words.take(pa.array(used)), [(p, w, n) for (p, _, n), w in zip(mine, places, strict=True)])


def merged_tries(tries: list[Trie]) -> Trie:
    """Tries as one, the counts of equal paths added up."""
    if len(tries) == 1:
        return tries[0]
    names = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[names.indices.to_numpy()]
    first_word = np.cumsum([0] + [len(t.words) for t in tries])
    levels: list[Level] = []
    node = np.zeros(1, np.int64)
    for level in range(max(len(t.levels) for t in tries)):
        some = [(t.levels[level], first_word[i], i) for i, t in enumerate(tries) if level < len(t.levels)]
        first_node = np.cumsum([0] + [len(t.levels[level - 1][1]) if 0 < level <= len(t.levels) else 0 for t in tries])
        above = np.concatenate([p + first_node[i] for (p, _, _), _, i in some])
        word = rank[np.concatenate([w + f for (_, w, _), f, _ in some])]
        count = np.concatenate([n for (_, _, n), _, _ in some])
        key = node[above] * max(1, len(order)) + word
        sorted_ = np.argsort(key, kind="stable")
        key = key[sorted_]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        node = np.empty(len(key), np.int64)
        node[sorted_] = np.cumsum(new) - 1
        counts = np.add.reduceat(count[sorted_], np.flatnonzero(new)) if len(key) else count
        levels.append((*divmod(key[new], max(1, len(order))), counts))
    return Trie(names.dictionary.take(pa.array(order)), levels)


def paths(trie: Trie, least: int = 0) -> Iterator[tuple[tuple[bytes, ...], list[int]]]:
    """The words and the counts along the path to each node that counts at least so much, first words apart, and to all first words."""
    above: dict[int, tuple] = {-1: ((), [])}
    for level, (parents, words, counts) in enumerate(trie.levels):
        some = np.flatnonzero(counts >= least) if level else np.arange(len(words))
        now = {}
        for i, parent, word, n in zip(some.tolist(), parents[some].tolist(), trie.words.take(pa.array(words[some])).to_pylist(), counts[some].tolist(), strict=True):
            path, ns = above[parent if level else -1]
            now[i] = (*path, word), [*ns, n]
        yield from now.values()
        above = now


def read_trie(trie: bytes) -> Iterator[Node]:
    """The nodes in the order of the walk."""
    return iter(sorted((path, counts[-1]) for path, counts in paths(load_trie(trie))))


def trie_of(nodes: list[Node]) -> Trie:
    """Nodes in the order of the walk as a trie; no node lacks the one above it."""
    names = sorted({word for path, _ in nodes for word in path})
    levels, places = [], {(): 0}
    for level in range(1, max((len(path) for path, _ in nodes), default=1) + 1):
        mine = [(path, n) for path, n in nodes if len(path) == level]
        levels.append((np.array([places[path[:-1]] for path, _ in mine], np.int64), np.array([bisect.bisect_left(names, path[-1]) for path, _ in mine], np.int64), np.array([n for _, n in mine], np.int64)))
        places = {path: i for i, (path, _) in enumerate(mine)}
    return Trie(pa.array(names, pa.binary()), levels)


def write_trie(nodes: list[Node]) -> bytes:
    return dump_trie(trie_of(nodes))


def merged(runs: list[list[Node]]) -> list[Node]:
    """Sorted runs of nodes as one, the counts of equal paths added up."""
    return sorted((path, counts[-1]) for path, counts in paths(merged_tries([trie_of(run) for run in runs])))


class Bounds(NamedTuple):
    """A language's prefix ranges: where they begin, and for each heavy first word its first range and how many it has."""

    starts: list[bytes]
    heavy: dict[bytes, tuple[int, int]]


_PARTS = {"lang": pa.string(), "prefix": pa.int32(), "trie": pa.binary()}


def _tries(bitmap, bounds, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, prefix, trie: the sub-tries of each shard."""

        def found() -> Iterator[tuple]:
            for shard in _read_shards(batches):
                at, pair = shard.pairs()
                bits = _top(pair, BITMAP_BITS)
                at = at[bitmap.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 > 0]
                del pair, bits
                if not len(at):
                    continue
                trie = count_trie(shard.x, at, shard.words, depth)
                mine = bounds.value.get(shard.lang, Bounds([], {}))
                first = trie.words.take(pa.array(trie.levels[0][1])).to_pylist()
                dealt = [mine.heavy.get(word) or (bisect.bisect_right(mine.starts, word), 1) for word in first]
                begins, ranges = (np.array(c, np.int64) for c in zip(*dealt, strict=True))
                for prefix, part in cut_trie(trie, begins, ranges.astype(np.uint64), word_hashes(trie.words, shard.lang)):
                    yield shard.lang, prefix, dump_trie(part)
                tidy()

        yield from _rows(found(), _PARTS)

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _merged_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Trie]]:
    """Rows sorted by their first columns, the last one a sub-trie: (those columns, the merged trie).

    A trie is merged again only when as many nodes wait as it has, so each node is merged a few times however many parts there are.
    """
    for key, rows in groupby(_values(batches), key=lambda row: row[:-1]):
        waiting: list[Trie] = []
        held = size = 0
        for row in rows:
            waiting.append(load_trie(row[-1]))
            size += waiting[-1].size()
            if size - held > max(held, NODES) or (len(waiting) > FAN_IN and size - held > held):
                waiting = [merged_tries(waiting)]
                held = size = waiting[0].size()
        yield key, merged_tries(waiting)
        tidy()


def _rows(found: Iterable[tuple], kinds: dict[str, pa.DataType], a_batch: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of so many, or of BATCH_BYTES in their last column where that is binary."""
    held: list[tuple] = []
    size, binary = 0, list(kinds.values())[-1] == pa.binary()
    for row in found:
        held.append(row)
        size += len(row[-1]) if binary else 0
        if len(held) == a_batch or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def _premerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(((*key[:2], dump_trie(trie)) for key, trie in _merged_prefixes(batches)), _PARTS)


def _walk(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, phrase, m, a, lefts: nodes that are frequent, with the counts on the path to each, from its first two words on."""
        found = ((lang, b" ".join(path), len(path), counts[-1], counts[1:-1]) for (lang, _), trie in _merged_prefixes(batches) for path, counts in paths(trie, least) if len(path) > 1)
        yield from _rows(found, {"lang": pa.string(), "phrase": pa.binary(), "m": pa.int32(), "a": pa.int64(), "lefts": pa.list_(pa.int64())})

    return run


def _words_from(m: int, first: int) -> F.Column:
    """The phrase from its word `first` (from 1) on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, m), " ")


def prefix_bounds(counted: DataFrame, least: int) -> dict[str, Bounds]:
    """Prefix ranges by language, of about RANGE_WORDS words each, and about RANGES in all.

    They begin at quantiles of at most BOUND_WORDS frequent words, taken by a hash. First words that fill a range alone, at most
    RANGES, have ranges of their own, which their second words are dealt to.
    """
    frequent = counted.where(F.col("n") >= least)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    size = max(RANGE_WORDS, total // RANGES)
    heavy = frequent.where(F.col("n") > size).collect()
    rest = frequent.where(F.col("n") <= size)
    taken = rest.orderBy(F.xxhash64("lang", "word"), "lang", "word").limit(BOUND_WORDS).collect()
    share = sum(r["n"] for r in taken) / ((rest.agg(F.sum("n")).first()[0] or 0) or 1)
    found: dict[str, Bounds] = {}
    for lang, rows in groupby(sorted(taken, key=lambda r: (r["lang"], r["word"])), key=lambda r: r["lang"]):
        held = 0
        for r in rows:
            if held >= size * share:
                found.setdefault(lang, Bounds([], {})).starts.append(bytes(r["word"]))
                held = 0
            held += r["n"]
    for lang, rows in groupby(sorted(heavy, key=lambda r: (r["lang"], r["word"])), key=lambda r: r["lang"]):
        mine = found.setdefault(lang, Bounds([], {}))
        base = len(mine.starts) + 1
        for r in rows:
            mine.heavy[bytes(r["word"])] = base, -(-r["n"] // size)
            base += mine.heavy[bytes(r["word"])][1]
    return found


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang) -> phrases (lang, phrase, m, a, lefts, rights) of 2 to depth words, and all words (lang, word, n).

    lefts and rights: the counts of the first 1, 2, ... words and of what is left behind them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    first = stored(rows.mapInArrow(_first_pass(SHARD_WORDS, HELD), "lang string, word binary, n long, block int, counts binary, shard binary"), "words")
    counted = stored(first.where("block IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    shards = first.where("block = -1").select("lang", "shard")
    sketch = spark.sparkContext.broadcast(frequency_sketch(first.where("block >= 0")))
    bounds = spark.sparkContext.broadcast(prefix_bounds(counted, least))
    total = counted.agg(F.sum("n")).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(pair_bitmap(shards, sketch, least, -(-total // PAIRS_A_RANGE) or 1))
    parts = "lang string, prefix int, trie binary"
    tries = shards.mapInArrow(_tries(bitmap, bounds, depth), parts)
    key = ["lang", "prefix"]
    most = shards.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > SHARDS_A_TASK:  # a range of very many parts is merged in two steps
        salted = tries.withColumn("salt", F.pmod(F.xxhash64("trie"), F.lit(-(-most // SHARDS_A_TASK))))
        salted = salted.repartition(*key, "salt").sortWithinPartitions(*key, "salt").select(*key, "salt", "trie")
        tries = salted.mapInArrow(_premerge, parts)
    ranges = tries.repartition(*key).sortWithinPartitions(*key)
    nodes = stored(ranges.mapInArrow(_walk(least), "lang string, phrase binary, m int, a long, lefts array<long>").withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    words = counted.where(F.col("n") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("a"))
    above = words.withColumn("rights", F.lit(None).cast("array<long>"))
    found = None
    for m in range(2, depth + 1):
        mine = nodes.where(F.col("m") == m).withColumns({"link": _words_from(m, 2), "one": F.substring_index("phrase", " ", 1)})
        linked = lookup(mine, above.select("lang", F.col("phrase").alias("link"), F.col("a").alias("_right"), F.col("rights").alias("_rights")), ["lang", "link"], ["phrase"], "inner")
        linked = linked.withColumn("rights", F.concat(F.array("_right"), F.coalesce("_rights", F.array().cast("array<long>"))))
        whole = lookup(linked, words.select("lang", F.col("phrase").alias("one"), F.col("a").alias("_left")), ["lang", "one"], ["phrase"], "inner")
        level = stored(whole.select("lang", "phrase", "m", "a", F.concat(F.array("_left"), "lefts").alias("lefts"), "rights"), "linked")
        found = level if found is None else found.unionByName(level)
        above = level.select("lang", "phrase", "a", "rights")
    return found, counted


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, percent: int = 100) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and bytes.

    A phrase's score is that of its weakest cut; a phrase within a longer one that occurs at least percent / 100 as often goes.
    A null language is `und`; null and empty texts have no words; repeated rows count as often as they are there; long texts are
    read whole, some pieces at a time; other columns are not read; an empty table gives no rows.
    """
    phrases, words = frequent_phrases(docs, depth, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = lookup(phrases, stored(totals, "totals"), ["lang"], ["phrase"], "inner")
    exact = lambda c: c.cast("decimal(19,0)")
    rows = rows.select("lang", "phrase", "m", "a", "n", F.col("lefts").alias("l"), F.col("rights").alias("r"), F.sequence(F.lit(1), F.col("m") - 1).alias("k"))
    cut_ = rows.select("lang", "phrase", "m", "a", "n", F.explode(F.arrays_zip("l", "r", "k")).alias("cut"))
    # Products of 38 digits at most; `div` is exact and floors what is not negative.
    cut_ = cut_.withColumns({"_over": F.lit(FACTOR).cast("decimal(5,0)") * exact(F.col("a")) * exact(F.col("n")), "_under": exact(F.col("cut.l")) * exact(F.col("cut.r"))})
    weakest = F.min(F.struct(F.expr("_over div _under").cast("long").alias("score"), "cut.k", "cut.l", "cut.r"))
    scored = stored(cut_.groupBy("lang", "phrase", "m", "a", "n").agg(weakest.alias("w")), "scored")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")))))
    longer = scored.where("m > 2").select("lang", "a", inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = lookup(scored, stored(longer, "longer"), ["lang", "phrase"], ["phrase"]).where(F.coalesce(100 * F.col("_longer") < percent * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "w.l", "w.r", "n", "w.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: All contiguous phrases counted as lists of words; parts of a frequent phrase are frequent, so rare ones are not needed.
ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang
), m AS (SELECT lang, ws, unnest(range(1, 6)) AS m FROM w
), g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: list_slice(ws, i, i + m - 1))) AS g FROM m WHERE len(ws) >= m
), f AS (SELECT lang, g, count(*)::HUGEINT AS a FROM g GROUP BY lang, g HAVING count(*) >= 100
), c AS (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1
), s AS (
  SELECT c.lang, c.g, c.a, n.n, c.k, l.a AS l, r.a AS r, 1000 * c.a * n.n // (l.a * r.a) AS score FROM c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k) JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, len(c.g))
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda j: list_slice(g, j, j + k - 1))))) AS g FROM f WHERE len(g) > 2
), x AS (SELECT lang, g, max(a) AS a FROM i GROUP BY lang, g
), o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE x.a IS NULL OR x.a < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""
