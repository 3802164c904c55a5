"""Suffix-array de-duplication: removes every byte that a `length`-byte string covers which also starts somewhere else.

Equal strings of that length hold equal minimizers, so the starts of all windows fall into runs that share one, and only runs
of a minimizer that occurs again can hold a repeat. Those pieces, equal ones once with their number, are dealt out by
minimizer; a piece that can meet no other there has nothing to be sorted among, and its number says what it is. Each shard of the rest gets its suffix array by induced sorting (classify suffixes, sort the leftmost-smaller
substrings, name them, recurse, induce) and its permuted common prefixes, and a stretch of the array whose common prefixes
reach `length` and whose pieces count two or more together is a repeat. Nothing is decided by hashes of windows: minimizers
only route, and every routed window is compared with all others of its route. A minimizer of very many distinct pieces (a
passage that many texts share, each going on differently) would be one shard that grows with the input: its windows are
parted by the place of the minimizer in them, HEAVY_STEP places together, and routed by what all windows of such a stretch
have in common, all but a few bytes at their ends. So they spread over all shards, and what still shares a route differs in
those few bytes only.

Induction runs bucket by bucket with array operations, linear in the shard. Substrings are sorted by their symbols and types,
as many as fit 64 bits at a time. What the recursion sorts is the string of their names without those that occur once after
another such name: no comparison reads on past a name that occurs once. Names too many for buckets are written as two digits,
which keeps their order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, table, text_runs, tidy
from .jaccard import _bloom_bits, id_filter

LENGTH = 200
GRAM = 48
SHARD_BYTES = 3 << 20
#: Distinct pieces of a minimizer up to which they are sorted in one shard, and the window starts that a piece of others covers.
HEAVY, HEAVY_STEP = 1 << 14, 4
#: Pieces that met no other and wait for a shard to be handed on with it.
ALONE = 1 << 16
#: Places of a minimizer in windows that are taken together when it is asked which of its pieces can meet.
SIEVE_STEP = 40
#: Names up to which a recursion uses them as they are; more are written as two digits.
MAX_BUCKETS = 1024
#: Bytes of a text that are read at a time: places have 28 bits beside the hash of a minimizer.
STRETCH = 1 << 27

_U = np.uint64


# ---- suffix arrays by induced sorting ----------------------------------------------------------------------------------


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last, a unique least symbol, counts as smaller."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return smaller


def _spread(array: np.ndarray, fill: np.ndarray, keys: np.ndarray, items: np.ndarray, sign: int) -> None:
    """Appends each item to the bucket of its key, in order, forwards from fill or backwards."""
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(heads, len(keys)))
    inside = np.arange(len(keys)) - np.repeat(heads, counts)
    array[fill[keys] + sign * inside] = items
    fill[keys[heads]] += sign * counts


def _induce(text: np.ndarray, smaller: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that leftmost-smaller suffixes in the order of `seeds` induce; starts: where buckets begin, and the end."""
    sa = np.full(len(text), -1, np.int32)
    sigma = len(starts) - 1
    first = text[seeds]
    order = np.argsort(first, kind="stable")
    held, first = seeds[order], first[order]
    ends = np.searchsorted(first, np.arange(sigma), side="right")
    begins = np.searchsorted(first, np.arange(sigma), side="left")
    fill = starts[:-1].copy()
    for c in range(sigma):  # larger suffixes, left to right
        lms = held[begins[c] : ends[c]]
        done = starts[c]
        if done == fill[c] and not len(lms):
            continue
        while done < fill[c]:  # what the bucket's own entries put into it
            new = sa[done : fill[c]] - 1
            done = fill[c]
            new = new[new >= 0]
            new = new[~smaller[new] & (text[new] == c)]
            sa[done : done + len(new)] = new
            fill[c] += len(new)
        before = np.concatenate([sa[starts[c] : fill[c]], lms]) - 1
        before = before[before >= 0]
        keys = text[before]
        far = ~smaller[before] & (keys > c)
        if far.any():
            _spread(sa, fill, keys[far], before[far], 1)
    larger_end = fill
    fill = starts[1:] - 1
    for c in range(sigma - 1, -1, -1):  # smaller suffixes, right to left
        done = starts[c + 1] - 1
        if done == fill[c] and larger_end[c] == starts[c]:
            continue
        while done > fill[c]:
            new = sa[fill[c] + 1 : done + 1][::-1] - 1
            done = fill[c]
            new = new[new >= 0]
            new = new[smaller[new] & (text[new] == c)]
            sa[done - len(new) + 1 : done + 1] = new[::-1]
            fill[c] -= len(new)
        before = np.concatenate([sa[fill[c] + 1 : starts[c + 1]][::-1], sa[starts[c] : larger_end[c]][::-1]]) - 1
        before = before[before >= 0]
        keys = text[before]
        far = smaller[before] & (keys < c)
        if far.any():
            _spread(sa, fill, keys[far], before[far], -1)
    sa[0] = len(text) - 1
    return sa


def substring_names(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """For each leftmost-smaller substring, how many are less: equal ones have the same name.

    A symbol and its type make one digit, so that no substring is the beginning of another, and as many digits as 64 bits hold
    are compared at a time, for those substrings that are still tied.
    """
    bits = max(1, int(2 * sigma - 1).bit_length())
    at_once = 64 // bits
    digit = text.astype(np.uint64) << _U(1) | smaller
    span = np.append(np.diff(lms) + 1, 1)

    def key(which: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for j in range(done, done + at_once):
            inside = span[which] > j
            out <<= _U(bits)
            out[inside] |= digit[lms[which[inside]] + j]
        return out

    def ranked(which: np.ndarray, order: np.ndarray, fresh: np.ndarray, base: np.ndarray) -> None:
        """Names in the order given; fresh: where a new one begins; base: what each item's group starts from."""
        place = np.arange(len(order))
        heads = np.maximum.accumulate(np.where(fresh, place, 0))
        names[which[order]] = base + heads

    names = np.zeros(len(lms), np.int64)
    everything = np.arange(len(lms))
    first = key(everything, 0)
    order = np.argsort(first, kind="stable")
    ranked(everything, order, np.concatenate([[True], first[order][1:] != first[order][:-1]]), np.zeros(len(lms), np.int64))
    done = at_once
    while True:
        tied = np.bincount(names, minlength=len(lms))[names] > 1
        live = np.flatnonzero(tied & (span > done))
        if not len(live):
            return names
        keys = key(live, done)
        order = np.lexsort((keys, names[live]))
        old, keys = names[live][order], keys[order]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        start = np.maximum.accumulate(np.where(group, np.arange(len(old)), 0))
        ranked(live, order, group | np.concatenate([[True], keys[1:] != keys[:-1]]), old - start)
        done += at_once


def _sorted_lms(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names; the last is the least and occurs once, equal names have equal counts of lesser ones."""
    n = len(names)
    shared = np.bincount(names, minlength=n)[names] > 1
    out = np.empty(n, np.int64)
    out[names[~shared]] = np.flatnonzero(~shared)
    if not shared.any():
        return out
    # Each stretch of names that occur again, with the one after it, which occurs once and ends every comparison.
    kept = np.flatnonzero(shared | np.concatenate([[False], shared[:-1]]))
    used = np.zeros(n, bool)
    used[names[kept]] = True
    reduced = np.append(np.cumsum(used)[names[kept]], 0)
    count = int(reduced.max()) + 1
    if count <= MAX_BUCKETS:
        order = suffix_array(reduced, count)
    else:
        base = int(np.ceil(np.sqrt(count))) + 1
        digits = np.zeros(2 * len(reduced) - 1, np.int32)
        digits[:-1:2] = reduced[:-1] // base + 1
        digits[1::2] = reduced[:-1] % base + 1
        order = suffix_array(digits, base + 2)
        order = order[order % 2 == 0] // 2
    order = kept[order[1:]]
    order = order[shared[order]]
    of = names[order]
    heads = np.maximum.accumulate(np.where(np.concatenate([[True], of[1:] != of[:-1]]), np.arange(len(of)), 0))
    out[of + np.arange(len(of)) - heads] = order
    return out


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols below sigma, the last of which is 0 and occurs only there."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    text = text.astype(np.uint16)
    smaller = classify(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    return _induce(text, smaller, starts, lms[_sorted_lms(substring_names(text, smaller, lms, sigma))])


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """At each position, the common prefix of its suffix and the one before it in the array, cut off at the position's stop.

    Only where the symbols before the two suffixes differ is the prefix counted; elsewhere it is one less than its left
    neighbour's.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    fresh = np.ones(n, bool)
    b = before[1:]
    fresh[1:] = (b < 1) | (text[:-1] != text[np.maximum(b - 1, 0)])
    fresh[1:] |= stops[1:] != stops[:-1]
    at = np.flatnonzero(fresh)
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8]
    got = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        p, q = at[live] + got[live], before[at[live]] + got[live]
        inside = (p < n) & (q < n) & (p < stops[at[live]])
        live, p, q = live[inside], p[inside], q[inside]
        if not len(live):
            break
        apart = np.ascontiguousarray(wide[p]).view("<u8").ravel() ^ np.ascontiguousarray(wide[q]).view("<u8").ravel()
        low = apart & (~apart + _U(1))
        equal = np.where(apart == 0, 8, np.bitwise_count(low - _U(1)).astype(np.int64) >> 3)
        got[live] += equal
        live = live[equal == 8]
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[at] = got
    return np.clip(value[last] - (np.arange(n) - last), 0, stops - np.arange(n))


def repeats(pieces: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, whether the `length`-byte string at each of its starts occurs again in the pieces, taken counts[i] times each."""
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = raw.astype(np.uint16) + 2
    text[ends] = 1
    text = np.append(text, np.uint16(0))
    stops = np.append(np.repeat(ends, sizes + 1), len(text) - 1)
    sa = suffix_array(text, 258)
    # 254 and up are no bytes of UTF-8, so the shifted symbols still fit a byte.
    prefixes = permuted_prefixes(np.minimum(text, 255), sa, stops)
    group = np.cumsum(prefixes[sa] < length)
    starts = np.arange(len(text)) + length <= stops
    weight = np.where(starts, np.append(np.repeat(np.array(counts, np.int64), sizes + 1), 0), 0)
    total = np.bincount(group, weights=weight[sa])
    again = np.zeros(len(text), bool)
    again[sa] = total[group] >= 2
    again &= starts
    opens = ends - sizes
    return [again[o : o + max(0, s - length + 1)] for o, s in zip(opens.tolist(), sizes.tolist(), strict=True)]


# ---- pieces ------------------------------------------------------------------------------------------------------------

_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), _U(base))
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the gram at each position."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _power(_INVERSE, len(data) - gram + 1)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def minimizer_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of window starts begins whose windows share one place of their (leftmost) minimizer, with the end; the minimizers; and their places.

    Places have 28 bits and hashes are compared by their other 36, so a longer text is read in stretches; a run that goes on in
    the next one is two.
    """
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > STRETCH:
        parts = [(a, minimizer_runs(data[a : a + STRETCH + length - 1], length, gram)) for a in range(0, n, STRETCH)]
        return np.append(np.concatenate([a + edges[:-1] for a, (edges, _, _) in parts]), n), np.concatenate([least for _, (_, least, _) in parts]), np.concatenate([a + at for a, (_, _, at) in parts])
    h = gram_hashes(data, gram)
    width, size = length - gram + 1, 1
    least = (h >> _U(28) << _U(28)) | np.arange(len(h), dtype=np.uint64)
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[width - size :][:n])
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (least[heads] & _U((1 << 28) - 1)).astype(np.int64)
    return np.append(heads, n), h[at].astype(np.int64), at


def heavy_pieces(data: bytes, edges: np.ndarray, places: np.ndarray, runs: list[int], length: int) -> Iterator[tuple[int, int, bytes]]:
    """route, first start and bytes of the pieces of heavy runs.

    Windows that hold their minimizer at one of HEAVY_STEP neighbouring places are a piece; its route is the hash of the bytes
    that all possible windows of those places share. Equal windows hold it at the same place, so they have the same route.
    """
    core = length - HEAVY_STEP + 1
    for j in runs:
        begin, stop, at = int(edges[j]), int(edges[j + 1]), int(places[j])
        while begin < stop:
            step = (at - begin) // HEAVY_STEP
            latest = at - step * HEAVY_STEP  # the last start whose windows belong here
            upto = min(stop, latest + 1)
            yield _signed(xxhash.xxh3_64_intdigest(data[latest : latest + core], seed=step + 1)), begin, data[begin : upto - 1 + length]
            begin = upto


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


KEY = "k1 long, k2 long"


def keyed(docs: DataFrame) -> DataFrame:
    """docs plus k1 and k2, which stand for the text: equal texts lose the same bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.shiftleft(F.crc32(text), 31) + F.octet_length(text)})


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: starts (int32), minimizers (int64) and digests (16 bytes) of its pieces, packed."""
        for batch in batches:
            done = 0
            for texts in text_runs(batch.column(2)):
                out: tuple[list, list, list] = ([], [], [])
                for text in texts:
                    data = _bytes(text)
                    edges, least, _ = minimizer_runs(np.frombuffer(data, np.uint8), length, gram)
                    out[0].append(edges[:-1].astype("<i4").tobytes())
                    out[1].append(least.astype("<i8").tobytes())
                    out[2].append(b"".join([xxhash.xxh3_128_digest(data[a : z + length - 1]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]))
                rows = slice(done, done + len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], *(pa.array(o, pa.binary()) for o in out)], ["k1", "k2", "starts", "least", "digests"])
            tidy()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """least, n, kinds: how often each minimizer occurs in a batch, and with how many distinct pieces (by half a digest)."""
    for batch in batches:
        all_ = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
        half = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")[::2]
        order = np.lexsort((half, all_))
        all_, half = all_[order], half[order]
        least, heads, n = np.unique(all_, return_index=True, return_counts=True)
        fresh = np.ones(len(all_), np.int64)
        fresh[1:] = (all_[1:] != all_[:-1]) | (half[1:] != half[:-1])
        kinds = np.add.reduceat(fresh, heads) if len(heads) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(n.astype(np.int64)), pa.array(kinds)], ["least", "n", "kinds"])


def _among(least: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which minimizers are heavy; heavy is sorted."""
    if not len(heavy):
        return np.zeros(len(least), bool)
    return heavy[np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)] == least


def _of_heavy(heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """least, half a digest: the distinct pieces of a batch whose minimizer may be heavy."""
        for batch in batches:
            all_ = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            half = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")[::2]
            mine = _among(all_, heavy.value)
            found = np.unique(np.stack([all_[mine], half[mine]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["least", "half"])

    return run


def _heavy_places(length: int, gram: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """digest, k1, k2, start of the pieces of heavy minimizers."""
        for batch in batches:
            k1, k2 = (batch.column(c).to_pylist() for c in (0, 1))
            done = 0
            for texts in text_runs(batch.column(2)):
                out: list[tuple] = []
                for i, text in enumerate(texts, done):
                    data = _bytes(text)
                    edges, least, places = minimizer_runs(np.frombuffer(data, np.uint8), length, gram)
                    mine = np.flatnonzero(_among(least, heavy.value)).tolist()
                    out += [(xxhash.xxh3_128_digest(piece), k1[i], k2[i], start) for _, start, piece in heavy_pieces(data, edges, places, mine, length)]
                done += len(texts)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], ["digest", "k1", "k2", "start"])
            tidy()

    return run


def _routed(wanted, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """digest, k1, k2, start of the pieces whose minimizer may be wanted."""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                starts = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i4")
                least = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i8")
                digests = np.frombuffer(b"".join(part.column(4).to_pylist()), "S16")
                count = np.array([len(x) // 4 for x in part.column(2).to_pylist()])
                bits = _bloom_bits(least)
                mine = np.flatnonzero((wanted.value[bits >> 3] >> (bits & 7) & 1).astype(bool) & ~_among(least, heavy.value))
                k1, k2 = (np.repeat(part.column(c).to_numpy(), count)[mine] for c in (0, 1))
                raw = b"".join(part.column(4).to_pylist())
                del digests
                yield pa.RecordBatch.from_arrays([pa.array([raw[16 * i : 16 * i + 16] for i in mine.tolist()], pa.binary()), pa.array(k1), pa.array(k2), pa.array(starts[mine])], ["digest", "k1", "k2", "start"])

    return run


def _contents(length: int, gram: int, wanted, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """least, digest, n, piece, at: the pieces that may be wanted, equal ones of a run of texts once with their number; at: where they hold the minimizer."""
        for batch in batches:
            for texts in text_runs(batch.column(0), 4 << 20):
                held: dict[bytes, list] = {}
                for text in texts:
                    data = _bytes(text)
                    edges, least, places = minimizer_runs(np.frombuffer(data, np.uint8), length, gram)
                    bits = _bloom_bits(least)
                    hot = _among(least, heavy.value)
                    routed = ((int(least[i]), int(places[i] - edges[i]), data[edges[i] : edges[i + 1] + length - 1]) for i in np.flatnonzero((wanted.value[bits >> 3] >> (bits & 7) & 1).astype(bool) & ~hot).tolist())
                    spread = ((route, -1, piece) for route, _, piece in heavy_pieces(data, edges, places, np.flatnonzero(hot).tolist(), length))
                    for route, at, piece in itertools.chain(routed, spread):
                        digest = xxhash.xxh3_128_digest(piece)
                        if digest in held:
                            held[digest][1] += 1
                        else:
                            held[digest] = [route, 1, piece, at]
                if held:
                    least, n, piece, at = zip(*held.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(list(held), pa.binary()), pa.array(n, pa.int64()), pa.array(piece, pa.binary()), pa.array(at, pa.int32())], ["least", "digest", "n", "piece", "at"])
            tidy()

    return run


def meetings(pieces: list[bytes], places: list[int], length: int) -> list[bool]:
    """Which pieces of a minimizer may share a window with another one of them; places: where they hold it.

    Equal windows hold it at the same place, so pieces meet by what all windows of SIEVE_STEP neighbouring places have in common.
    A piece without a place (-1) may meet all.
    """
    if len(pieces) == 1:
        return [False]
    step = min(SIEVE_STEP, length)
    core = length - step + 1
    first: dict[int, int] = {}
    out = [at < 0 for at in places]
    for i, (piece, at) in enumerate(zip(pieces, places, strict=True)):
        begin, stop = 0, 0 if at < 0 else len(piece) - length + 1
        while begin < stop:
            k = (at - begin) // step
            latest = at - k * step
            other = first.setdefault(xxhash.xxh3_64_intdigest(piece[latest : latest + core], seed=k), i)
            if other != i:
                out[i] = out[other] = True
            begin = latest + 1
    return out


def _sorted_shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """digest, spans (int32 pairs: first start, end) of pieces with repeats. Rows come sorted by minimizer and digest."""
        shard: tuple[list, list, list] = ([], [], [])  # digests, numbers and bytes of the pieces to be sorted
        group: tuple[list, list, list, list] = ([], [], [], [])  # the same of the last minimizer, and where pieces hold it
        out: tuple[list, list] = ([], [])

        def close() -> int:
            """Deals out the group: what meets no other piece has nothing to be sorted among, and its number says what it is."""
            size = 0
            for digest, n, piece, meets in zip(*group[:3], meetings(group[2], group[3], length), strict=True):
                if meets:
                    for column, value in zip(shard, (digest, n, piece), strict=True):
                        column.append(value)
                    size += len(piece)
                elif n > 1:
                    out[0].append(digest)
                    out[1].append(np.array([0, len(piece) - length + 1], "<i4").tobytes())
            for column in group:
                column.clear()
            return size

        def solve() -> pa.RecordBatch:
            for digest, again in zip(shard[0], repeats(shard[2], shard[1], length) if shard[2] else (), strict=True):
                if again.any():
                    edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
                    out[0].append(digest)
                    out[1].append(edge.astype("<i4").tobytes())
            found = pa.RecordBatch.from_arrays([pa.array(o, pa.binary()) for o in out], ["digest", "spans"])
            for column in (*shard, *out):
                column.clear()
            tidy()
            return found

        last, size = None, 0
        for batch in batches:
            for least, digest, n, piece, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if least != last:
                    size += close() if group[0] else 0
                    if size >= shard_bytes or len(out[0]) >= ALONE:
                        yield solve()
                        size = 0
                    last = least
                if group[0] and group[0][-1] == digest:
                    group[1][-1] += n
                    continue
                for column, value in zip(group, (digest, n, piece, at), strict=True):
                    column.append(value)
        if group[0]:
            close()
        if shard[0] or out[0]:
            yield solve()

    return run


def _intervals(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, span: bytes of a text to remove."""
        for batch in batches:
            spans = batch.column(3).to_pylist()
            flat = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
            count = np.array([len(s) // 8 for s in spans], np.int64)
            k1, k2, start = (np.repeat(batch.column(c).to_numpy(), count) for c in (0, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(start + flat[:, 0]), pa.array(start + flat[:, 1] + length - 1)], ["k1", "k2", "begin", "stop"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts (k1, k2, text) -> k1, k2, spans: byte spans (begin, stop; they may overlap) of the texts that lose any."""
    spark = texts.sparkSession
    found = cut(texts.select("k1", "k2", "text").mapInArrow(_occurrences(length, gram), f"{KEY}, starts binary, least binary, digests binary"))
    counted = found.select("least", "digests").mapInArrow(_counted, "least long, n long, kinds long").groupBy("least").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    again = cut(counted.where("n > 1").select("least", (F.col("kinds") > HEAVY).alias("heavy")))
    wanted = spark.sparkContext.broadcast(id_filter(again.select("least")))
    # Counted batch by batch a piece that all batches hold seems to be many: those that seem heavy are counted exactly.
    heavy = np.sort(np.array([r["least"] for r in again.where("heavy").collect()], np.int64))
    if len(heavy):
        kinds = found.select("least", "digests").mapInArrow(_of_heavy(spark.sparkContext.broadcast(heavy)), "least long, half long").distinct()
        heavy = np.sort(np.array([r["least"] for r in kinds.groupBy("least").count().where(F.col("count") > HEAVY).collect()], np.int64))
    heavy = spark.sparkContext.broadcast(heavy)
    pieces = texts.select("text").mapInArrow(_contents(length, gram, wanted, heavy), "least long, digest binary, n long, piece binary, at int")
    shards = pieces.repartition("least").sortWithinPartitions("least", "digest")
    repeated = cut(shards.mapInArrow(_sorted_shards(length, shard_bytes), "digest binary, spans binary"))
    places = found.mapInArrow(_routed(wanted, heavy), f"digest binary, {KEY}, start int")
    if len(heavy.value):
        places = places.unionByName(texts.select("k1", "k2", "text").mapInArrow(_heavy_places(length, gram, heavy), f"digest binary, {KEY}, start int"))
    spans = places.join(repeated, "digest").select("k1", "k2", "start", "spans").mapInArrow(_intervals(length), f"{KEY}, begin long, stop long")
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for begin, stop in spans:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((begin, stop))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (text and any other columns) plus spans: the byte spans of the text that other places repeat.

    Bytes are those of UTF-8; a null text is empty; texts shorter than `length` lose nothing; documents with equal texts lose
    all of it; repeated rows and null ids are rows like any other; an empty table gives an empty result; columns named spans, k1
    and k2 are replaced.
    """
    docs = docs.drop("spans", "k1", "k2")
    texts = keyed(docs)
    able = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) >= length
    spans = cut(repeated_spans(texts.where(able), length))
    short = docs.where(~able).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    # Texts of one key lose the same bytes; keys of very many texts are spread.
    long = lookup(texts.where(able).withColumn("_row", F.monotonically_increasing_id()), spans, ["k1", "k2"], ["_row"], wide=True)
    return long.select(*docs.columns, "spans").unionByName(short)


def _digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    columns: list[list] = [[], [], [], []]
    at = 0
    for run in text_runs(texts):
        for text in run:
            data = _bytes(text)
            gone = merged([(s["begin"], s["stop"]) for s in spans[at].as_py() or ()])
            at += 1
            kept, place = [], 0
            for begin, stop in gone:
                kept.append(data[place:begin])
                place = stop
            kept.append(data[place:])
            values = len(data), sum(z - a for a, z in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()
            for column, value in zip(columns, values, strict=True):
                column.append(value)
    tidy()
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.arrow_udf(_digest, "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    return found.select("doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.*")


#: All 200-byte windows of all texts, in hexadecimal, by their digests; long texts are read by stretches, as places in a string are counted from its start.
ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (SELECT doc_id, j, substr(h, 512 * j + 1, 910) AS h FROM (SELECT doc_id, h, unnest(range((n - 200) // 256 + 1)) AS j FROM b WHERE n >= 200)
), w AS (SELECT doc_id, 256 * j + o AS i, md5(substr(h, 2 * o + 1, 400)) AS k FROM (SELECT doc_id, j, h, unnest(range(least(256, length(h) // 2 - 199))) AS o FROM c)
), r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r
), g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), x AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run
), p AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x
), k AS (SELECT p.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM p JOIN b ON b.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN k ON k.doc_id = b.doc_id
"""
