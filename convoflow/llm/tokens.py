"""Token ids of whole texts, and a binary file format for them with constant-time keyed access.

A folder holds numbered shards in ascending document order. Each shard is two files: `NNNNNN.ids`, the ids alone, raw and
little-endian, one document after the other; and `NNNNNN.mph`, a minimal perfect hash over the shard's document keys, whose
slot of a key holds the key's fingerprint, its offset and its length. Ranks of the hash's bits are stored block by block, so
looking a key up seeks to a few words, whatever the shard's size; a key that the shard does not hold is told by its fingerprint
(wrong once in 2**32).

Shards are ranges of document ids with about equal counts, found from the id column alone, so texts are encoded where they
are read and only ids are shuffled. Writers stream, write under an attempt's own name and rename, so that a task that runs
twice leaves the same files.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_folder, table, text_runs, tidy

SHARD_BYTES = 64 << 20
#: Pieces an encoder remembers before it starts anew.
CACHE_PIECES = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _loaded(path: str):
    """The tokenizer of a file, the narrowest type of its ids, which ids open with a space, and a pattern of its added tokens."""
    # Tasks are the parallelism here: a pool of threads in each worker takes memory and yields no speed.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    size = max(vocabulary.values()) + 1
    opens = np.zeros(size, dtype=bool)
    opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = re.compile("|".join(map(re.escape, added))) if added else None
    return tokenizer, np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4"), opens, whole


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, as little-endian bytes of `dtype`.

    That pre-tokenizer always starts a new unit at a single space between two characters that are not white space, and merges
    never cross units. So a text's ids are those of its space-separated pieces, one after the other, and each distinct piece
    is handed to the library once. Texts with other uses of spaces are parted only at such places, and texts that hold an added
    token of the file (which the library finds before it looks for spaces) are handed over whole.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer, self.dtype, self.opens, self.added = _loaded(path)
        self.cache: dict[str, bytes | None] = {}
        self.cache_pieces = cache_pieces
        self.stops = {c: self._whole([c])[0] for c in ".,"}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Adds the ids of each piece as they are after a single space; None for pieces that must not be parted from what is around them."""
        todo, stopped = [], []
        for piece in pieces:
            if not piece or len(piece.strip()) < len(piece):
                self.cache[piece] = None
            elif piece[-1] in self.stops and piece[:-1].isalpha() and (piece.isascii() or max(piece) < "ɐ"):
                stopped.append(piece)
            else:
                todo.append(piece)
        held = self.cache
        todo += list({p[:-1] for p in stopped}.difference(held, todo))
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            joined = [" " + " ".join(part[j : j + 64]) for j in range(0, len(part), 64)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                held.update(zip(part, self._whole([" " + p for p in part]), strict=True))
                continue
            buffer, at = ids.tobytes(), [*(at * ids.itemsize).tolist(), ids.nbytes]
            held.update((p, buffer[a:z]) for p, a, z in zip(part, at[:-1], at[1:], strict=True))
        for piece in stopped:
            held[piece] = held[piece[:-1]] + self.stops[piece[-1]]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").split(" ") if not (t and self.added and self.added.search(t)) else [""] for t in texts]
        self._need(split)
        heads = self._whole([s[0] if s[0] else " " for s in split])
        out, get = [], self.cache.__getitem__
        for i, (pieces, head) in enumerate(zip(split, heads, strict=True)):
            first = pieces[0]
            try:
                if not first or first[-1].isspace():
                    raise TypeError
                out.append(head + b"".join(map(get, pieces[1:])))
            except TypeError:  # spaces beside other white space
                out.append(self._odd(texts[i] or ""))
                get = self.cache.__getitem__
        return out

    def _need(self, split: list[list[str]]) -> None:
        wanted: set[str] = set()
        for pieces in split:
            wanted.update(pieces[1:])
        missing = wanted.difference(self.cache)
        if missing:
            if len(self.cache) + len(missing) > self.cache_pieces:  # frequent pieces are among those wanted now
                self.cache = {p: self.cache[p] for p in wanted.difference(missing)}
            self._learn(missing)

    def _odd(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added and self.added.search(text):
            return self._whole([text])[0]
        pieces = re.split(r"(?<=\S) (?=\S)", text)
        ids = self._whole([pieces[0], *(" " + p for p in pieces[1:])])
        return b"".join(ids)


@functools.lru_cache(maxsize=1)
def kept_encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """An encoder that a Python worker keeps: what one task has learnt, the worker's next need not learn again."""
    return Encoder(path, cache_pieces)


# ---- minimal perfect hash ----------------------------------------------------------------------------------------------

MAGIC = b"MPHIDS2\0"
#: Words of 64 bits between two stored ranks.
RANK_WORDS = 8
_U = np.uint64


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer: equal inputs and seeds give equal outputs everywhere."""
    x = x ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_hash(doc_ids: np.ndarray, null: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64 bits of (document id or null, number of its copy)."""
    h = mix64(np.where(null, 0, doc_ids).astype(np.int64).view(np.uint64), 1)
    return mix64(h + copies.astype(np.uint64), 2) ^ null.astype(np.uint64)


def rank(before: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bits at `at`, given what precedes their block and the block's words: the number of set bits before (-1 if not set), and whether they are set."""
    word, bit = at // 64 % RANK_WORDS, (at % 64).astype(np.uint64)
    mine = words[np.arange(len(at)), word]
    below = np.where(np.arange(RANK_WORDS) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
    held = (mine >> bit & _U(1)).astype(bool)
    return np.where(held, before + below + np.bitwise_count(mine & ((_U(1) << bit) - _U(1))), -1), held


class PerfectHash:
    """Levels of bit arrays: a key owns the first level's bit that no other key left there shares; its slot is the bit's rank."""

    LOAD = 1.7

    def __init__(self, sizes: list[int], bits: np.ndarray, seed: int, ranks: np.ndarray | None = None):
        self.sizes, self.seed = sizes, seed
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blocks = np.append(bits, np.zeros(-len(bits) % RANK_WORDS, "<u8")).reshape(-1, RANK_WORDS)
        if ranks is None:
            counts = np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64)
            ranks = np.cumsum(counts) - counts
        self.ranks = ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        for seed in range(100, 1000, 100):
            left, sizes, parts = keys, [], []
            while len(left) and len(sizes) < 60:
                size = -(-max(64, int(len(left) * cls.LOAD)) // 64) * 64
                at = (mix64(left, seed + len(sizes)) % _U(size)).astype(np.int64)
                alone = np.bincount(at, minlength=size) == 1
                sizes.append(size)
                parts.append(np.packbits(alone, bitorder="little").view("<u8"))
                left = left[~alone[at]]
            if not len(left):
                return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"), seed)
        raise ValueError("keys are not distinct")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (mix64(keys[todo], self.seed + level) % _U(size)).astype(np.int64) + self.base[level]
            out[todo], held = rank(self.ranks[at // (64 * RANK_WORDS)], self.blocks[at // (64 * RANK_WORDS)], at)
            todo = todo[~held]
        return out


class ShardIndex:
    """What a `.mph` file holds: the hash, and by slot the fingerprint, offset and length (in ids) of a key."""

    def __init__(self, mph: PerfectHash, fingerprints: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, itemsize: int):
        self.mph, self.fingerprints, self.offsets, self.lengths, self.itemsize = mph, fingerprints, offsets, lengths, itemsize

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys, 3) >> _U(32)).astype("<u4")

    @classmethod
    def build(cls, keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, itemsize: int) -> ShardIndex:
        mph = PerfectHash.build(keys)
        slot = np.argsort(mph.slots(keys))
        return cls(mph, cls.fingerprint(keys)[slot], offsets[slot].astype("<u8"), lengths[slot].astype("<u8"), itemsize)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key; length -1 where the shard does not hold it."""
        slots = self.mph.slots(keys)
        n = len(self.fingerprints)
        safe = np.clip(slots, 0, max(0, n - 1))
        if not n:
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        held = (slots >= 0) & (self.fingerprints[safe] == self.fingerprint(keys))
        return self.offsets[safe].astype(np.int64), np.where(held, self.lengths[safe].astype(np.int64), -1)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QQQQ", len(self.fingerprints), len(self.mph.sizes), self.mph.seed, self.itemsize)
        parts = [np.array(self.mph.sizes, "<u8"), self.mph.blocks, self.mph.ranks.astype("<u8"), self.fingerprints, self.offsets, self.lengths]
        return b"".join([head, *(p.tobytes() for p in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        if data[:8] != MAGIC:
            raise ValueError("not an index of token shards")
        n, levels, seed, itemsize = struct.unpack_from("<QQQQ", data, 8)
        at = 40

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype, count, at)
            at += found.nbytes
            return found

        sizes = take("<u8", levels).astype(np.int64).tolist()
        blocks = -(-(sum(sizes) // 64) // RANK_WORDS)
        bits, ranks = take("<u8", blocks * RANK_WORDS), take("<u8", blocks).astype(np.int64)
        return cls(PerfectHash(sizes, bits, seed, ranks), take("<u4", n), take("<u8", n), take("<u8", n), itemsize)


def find_in_file(index, key: np.ndarray) -> tuple[int, int, int]:
    """Offset, length (-1: not held) and item size of one key (an array of one), from an open `.mph` file.

    Each level that is probed is one read of a block of bits and one of its rank; then the slot's three numbers are read. A key
    passes two levels on average, whatever the shard's size, and never more than the levels that there are.
    """

    def take(dtype: str, count: int, at: int) -> np.ndarray:
        return np.frombuffer(index.read_at(count * np.dtype(dtype).itemsize, at), dtype)

    if index.read_at(8, 0) != MAGIC:
        raise ValueError("not an index of token shards")
    n, levels, seed, itemsize = take("<u8", 4, 8).tolist()
    sizes = take("<u8", levels, 40).astype(np.int64)
    blocks = -(-(int(sizes.sum()) // 64) // RANK_WORDS)
    bits_at = 40 + 8 * levels
    ranks_at = bits_at + 8 * RANK_WORDS * blocks
    slots_at = ranks_at + 8 * blocks
    base = 0
    for level, size in enumerate(sizes.tolist()):
        at = (mix64(key, seed + level) % _U(size)).astype(np.int64) + base
        block = int(at[0]) // (64 * RANK_WORDS)
        slot, held = rank(take("<u8", 1, ranks_at + 8 * block).astype(np.int64), take("<u8", RANK_WORDS, bits_at + 8 * RANK_WORDS * block)[None], at)
        if held[0]:
            s = int(slot[0])
            if take("<u4", 1, slots_at + 4 * s)[0] != ShardIndex.fingerprint(key)[0]:
                break
            return int(take("<u8", 1, slots_at + 4 * n + 8 * s)[0]), int(take("<u8", 1, slots_at + 12 * n + 8 * s)[0]), itemsize
        base += size
    return 0, -1, itemsize


# ---- shards ------------------------------------------------------------------------------------------------------------


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def shard_name(shard: int) -> str:
    return f"{shard:06d}"


def copy_numbers(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """0, 1, ... among the rows of one id; rows come sorted by id, nulls last."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def shard_bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """Largest ids of all shards but the last: approximate quantiles of doc_id, as many as the texts' bytes ask for."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    return sorted(set(docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * shards))).first()[0] or []))


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """doc_id, shard, ids (little-endian, of the narrowest type): a map over docs, no shuffle."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids, null = _ids_of(batch.column(0))
            shard = np.where(null, len(edges), np.searchsorted(edges, ids, side="left"))
            done = 0
            for part in map(encoder, text_runs(batch.column(1))):
                rows = slice(done, done + len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(shard[rows], pa.int32()), pa.array([p + end for p in part], pa.binary())], ["doc_id", "shard", "ids"]
                )
            tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shard int, ids binary")


def _writer(folder: str, itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        shard, stream, temporary = None, None, ""
        keys: list[tuple[np.ndarray, np.ndarray]] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            stream.close()
            ids, null = (np.concatenate(x) for x in zip(*keys, strict=True))
            sizes = np.concatenate(lengths)
            index = ShardIndex.build(key_hash(ids, null, copy_numbers(ids, null)), np.cumsum(sizes) - sizes, sizes, itemsize)
            with filesystem.open_output_stream(f"{temporary}.mph") as out:
                out.write(index.to_bytes())
            for kind in ("ids", "mph"):
                filesystem.move(f"{temporary}.{kind}", f"{root}/{shard_name(shard)}.{kind}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(sizes)], "n_ids": [int(sizes.sum())]})

        for batch in batches:
            shards = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            tidy()
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if shards[a] != shard:
                    if stream is not None:
                        yield close()
                    shard, keys, lengths = int(shards[a]), [], []
                    temporary = f"{root}/_{shard_name(shard)}-{uuid.uuid4().hex}"
                    stream = filesystem.open_output_stream(f"{temporary}.ids")
                payload = batch.column(2)[a:z].to_pylist()
                stream.write(b"".join(payload))
                keys.append(_ids_of(batch.column(0)[a:z]))
                lengths.append(np.array([len(p) // itemsize for p in payload], np.int64))
        if stream is not None:
            yield close()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, list[int]]:
    """Writes docs (doc_id, text) to folder; returns the manifest (shard, n_docs, n_ids) and the shards' bounds.

    A null text is empty; a null id comes after all others; rows that repeat an id are copies 0, 1, ... of it, in the order of
    their ids; an empty table writes nothing. Other columns are not read.
    """
    tokenizer = tokenizer or default_tokenizer()
    itemsize = Encoder(tokenizer).dtype.itemsize
    bounds = shard_bounds(docs, shard_bytes)
    rows = encoded(docs, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids")
    return cut(rows.mapInArrow(_writer(folder, itemsize), "shard int, n_docs long, n_ids long")), bounds


def _reader(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        shard, index, payload = None, None, None
        last = (None, None, -1)  # id, null and copy number of the row before
        for batch in batches:
            shards, (ids, null) = batch.column(1).to_numpy(), _ids_of(batch.column(0))
            copies = copy_numbers(ids, null)
            if len(ids) and last[0] is not None and (ids[0], null[0]) == last[:2]:
                same = (ids == ids[0]) & (null == null[0])
                copies[same] += last[2] + 1
            if len(ids):
                last = (ids[-1], null[-1], int(copies[-1]))
            keys = key_hash(ids, null, copies)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if shards[a] != shard:
                    shard = int(shards[a])
                    if payload is not None:
                        payload.close()
                    with filesystem.open_input_stream(f"{root}/{shard_name(shard)}.mph") as found:
                        index = ShardIndex.from_bytes(found.read())
                    payload = filesystem.open_input_file(f"{root}/{shard_name(shard)}.ids")
                size = index.itemsize
                offsets, lengths = index.find(keys[a:z])
                if (lengths < 0).any():
                    raise KeyError("a key is not in its shard")
                for i in range(0, z - a, 2048):
                    part = slice(i, min(i + 2048, z - a))
                    wide = []
                    for o, n in zip(offsets[part].tolist(), lengths[part].tolist(), strict=True):
                        payload.seek(o * size)
                        wide.append(np.frombuffer(payload.read(n * size), f"<u{size}").astype("<u4").tobytes())
                    n = part.stop - part.start
                    columns = [batch.column(0)[a + part.start : a + part.stop], pa.array(copies[a:z][part]), pa.array([shard] * n, pa.int32()), pa.array(offsets[part]), pa.array(lengths[part]), pa.array([zlib.crc32(w) for w in wide], pa.int64())]
                    names = ["doc_id", "copy", "shard", "offset", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(wide, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_shards(keys: DataFrame, folder: str, manifest: DataFrame, bounds: list[int], with_ids: bool = True) -> DataFrame:
    """Looks every row of keys (doc_id) up in the folder: doc_id, copy, shard, start, n_tokens, ids_crc32 and, asked for, ids (little-endian uint32).

    start is the number of ids of all documents before. A key that was never written is an error.
    """
    edges = np.array(bounds, dtype=np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = _ids_of(batch.column(0))
            shard = np.where(null, len(edges), np.searchsorted(edges, ids, side="left"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int32())], ["doc_id", "shard"])

    routed = keys.select(F.col("doc_id").cast("long")).mapInArrow(route, "doc_id long, shard int")
    routed = routed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last())
    schema = "doc_id long, copy long, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = routed.mapInArrow(_reader(folder, with_ids), schema)
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_base"))
    return found.join(bases, "shard").withColumn("start", F.col("_base") + F.col("offset")).drop("_base", "offset")


def lookup(folder: str, bounds: list[int], doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one document, by a few small reads of its shard's index and one of its payload; None if it is not there."""
    filesystem, root = _filesystem(folder)
    null = np.array([doc_id is None])
    ids = np.array([doc_id or 0], np.int64)
    name = f"{root}/{shard_name(len(bounds) if null[0] else int(np.searchsorted(np.array(bounds, np.int64), ids)[0]))}"
    try:
        with filesystem.open_input_file(f"{name}.mph") as index:
            offset, length, size = find_in_file(index, key_hash(ids, null, np.array([copy])))
    except FileNotFoundError:
        return None
    if length < 0:
        return None
    with filesystem.open_input_file(f"{name}.ids") as payload:
        return np.frombuffer(payload.read_at(length * size, offset * size), f"<u{size}")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "token-shards")
    manifest, bounds = write_shards(docs, folder)
    found = read_shards(docs.select("doc_id"), folder, manifest, bounds, with_ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
