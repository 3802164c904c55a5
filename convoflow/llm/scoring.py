"""Language-model scoring by deleted interpolation of n-gram estimates (bigram, unigram, uniform).

P(w | v) mixes c(v, w) / c(v), c(w) / N and 1 / (V + 1) with weights that depend on how often v occurs, in buckets of a factor
of two. The weights come from expectation-maximisation on held-out counts: each training event in turn is deleted, and the
mixture of what the remaining counts say is fitted to it, for the bucket that its context then falls into.

Texts become blocks of a few million tokens, kept as files in the shared folder: the block's distinct token hashes, and each
document as numbers into them. Blocks then ask for counts: every block sends its sorted distinct keys and its own training
counts, dealt out by the leading bits of the key; who holds a range adds up what all blocks sent and answers each block in the
order it asked. A frequent n-gram is one key a block, so no key is hot, and no count table is ever broadcast: only the weights
and totals are.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, table, text_runs, tidy

BLOCK_TOKENS = 3_000_000
RANGE_KEYS = 2_000_000
EM_ROUNDS = 60
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n<end>", b"\n<start>"))
_U = np.uint64


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one compressed frame; the bytes of a number stand plane by plane, which suits small numbers."""
    head, parts = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append((name, a.dtype.str, len(a)))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(text)) + text + b"".join(parts))


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = struct.unpack_from("<I", raw)[0]
    at, out = 4 + size, {}
    for name, kind, n in json.loads(raw[4 : 4 + size]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * width
    return out


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def remainder(doc_id: int | None, folds: int = 5) -> int:
    """crc32 of the id as text, mod folds; a null id has an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


# ---- blocks ------------------------------------------------------------------------------------------------------------


class Block:
    """Documents as token numbers. tokens: all documents on end, each closed by the end token; hashes: sorted."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.hashes, self.tokens, self.lengths, self.ids, self.null, self.held = (arrays[k] for k in ("hashes", "tokens", "lengths", "ids", "null", "held"))
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.trained = ~self.held.astype(bool)[self.of]

    @classmethod
    def of_documents(cls, numbers: dict, tokens: list[np.ndarray], ids: list[int | None], held: list[bool]) -> Block:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        arrays = {
            "hashes": hashes[order],
            "tokens": place[np.concatenate(tokens)],
            "lengths": np.array([len(t) for t in tokens], np.int64),
            "ids": np.array([i or 0 for i in ids], np.int64),
            "null": np.array([i is None for i in ids], np.uint8),
            "held": np.array(held, np.uint8),
        }
        return cls(arrays)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the token before each, and whether there is none."""
        first = np.zeros(len(self.tokens), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        before = np.roll(self.tokens, 1)
        return before, first

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of (context, token), the first place of each, and each token's number among them."""
        before, first = self.contexts()
        h = np.where(first, _U(START), self.hashes[before]) * _U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> _U(32))) + self.hashes[self.tokens] * _U(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> _U(32)), return_index=True, return_inverse=True)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _blocks(folder: str, held_out: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes blocks; a row (block, tokens, kinds, trained documents) for each."""
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        context = TaskContext.get()
        task, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        numbers, tokens, ids, held, size, done = _Numbers(), [], [], [], 0, 0
        end = b"\n<end>"

        def close() -> pa.RecordBatch:
            block = Block.of_documents(numbers, tokens, ids, held)
            name = f"{task}-{attempt}-{done}"
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                out.write(packed(block.arrays))
            tidy()
            return pa.RecordBatch.from_pydict({"block": [name], "tokens": [len(block.tokens)], "kinds": [len(block.hashes)], "trained": [int((block.held == 0).sum())]})

        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1)):
                for text, doc_id in zip(texts, batch.column(0)[at : at + len(texts)].to_pylist(), strict=True):
                    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    found.append(end)
                    tokens.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    ids.append(doc_id)
                    held.append(remainder(doc_id) == held_out)
                    size += len(found)
                at += len(texts)
                if size >= block_tokens:
                    yield close()
                    numbers, tokens, ids, held, size, done = _Numbers(), [], [], [], 0, done + 1
        if tokens:
            yield close()

    return run


def _each(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[dict, Block]]:
    filesystem, root = _filesystem(folder)
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            with filesystem.open_input_stream(f"{root}/{row['block']}") as found:
                yield row, Block(unpacked(found.read()))
        tidy()


def _ranges(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Sorted keys by their leading bits."""
    if not len(keys):
        return []
    part = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    return [(int(part[a]), slice(a, z)) for a, z in zip(heads, [*heads[1:], len(keys)], strict=True)]


ASKED = "part long, block string, asked binary"


def _ask_tokens(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches, folder):
            count = np.bincount(block.tokens[block.trained], minlength=len(block.hashes)).astype(np.uint32)
            for part, s in _ranges(block.hashes, bits):
                yield pa.RecordBatch.from_pydict({"part": [part], "block": [row["block"]], "asked": [packed({"keys": block.hashes[s], "n": count[s]})]})

    return run


def _totals(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[dict]]:
    """Distinct keys of a range with their counts over all blocks, each block's keys as numbers among them, and what was asked."""
    asked = [unpacked(x) for x in rows["asked"]]
    keys, at = np.unique(np.concatenate([a["keys"] for a in asked]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([a["n"] for a in asked]), minlength=len(keys)).astype(np.int64)
    return keys, total, np.split(at, np.cumsum([len(a["keys"]) for a in asked])[:-1]), asked


def _answer_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    _, total, places, _ = _totals(rows)
    out = [{"part": part, "block": block, "counts": packed({"n": total[at]}), "tokens": 0, "kinds": 0} for part, block, at in zip(rows["part"], rows["block"], places, strict=True)]
    out.append({"part": rows["part"].iloc[0], "block": None, "counts": None, "tokens": int(total.sum()), "kinds": int((total > 0).sum())})
    return pd.DataFrame(out)


# ---- the mixture -------------------------------------------------------------------------------------------------------


def code(count: np.ndarray) -> np.ndarray:
    """0 for none, else 1 and the quarter octave: counts as the fit sees them."""
    return np.where(count > 0, 1 + np.rint(4 * np.log2(np.maximum(count, 1))), 0).astype(np.uint8)


def value_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(float) - 1) / 4), 0.0)


def bucket(codes: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 and the octave of its frequency."""
    return np.where(codes > 0, 1 + (codes.astype(np.int64) - 1) // 4, 0)


def fit_weights(events: pd.DataFrame, n: int, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """events (context, pair, token: codes of counts without the event; n: how many) -> weights by bucket of (pair, token, uniform).

    Buckets with few events start from, and lean on, the same prior of one event; an unseen context gives the pair no weight.
    """
    weights = np.full((64, 3), 1 / 3)
    if len(events):
        c, w = events["context"].to_numpy(), events["n"].to_numpy(float)
        seen = value_of(c)
        p = np.stack([np.where(seen > 0, value_of(events["pair"].to_numpy()) / np.maximum(seen, 1), 0.0), value_of(events["token"].to_numpy()) / max(1, n - 1), np.full(len(c), 1 / (v + 1))])
        p[0] = np.minimum(p[0], 1.0)
        b = bucket(c)
        for _ in range(rounds):
            share = weights[b].T * p
            share *= w / np.maximum(share.sum(axis=0), 1e-300)
            got = np.stack([np.bincount(b, weights=s, minlength=64) for s in share], axis=1) + 1 / 3
            weights = got / got.sum(axis=1, keepdims=True)
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def _joined(answers: list[dict]) -> np.ndarray:
    """Answers of all ranges, in the order of the keys."""
    return np.concatenate([unpacked(bytes(a["counts"]))["n"] for a in sorted(answers, key=lambda a: a["part"])]) if answers else np.zeros(0, np.int64)


def _context_counts(block: Block, counts: np.ndarray, documents: int) -> np.ndarray:
    before, first = block.contexts()
    return np.where(first, documents, counts[before])


def _ask_pairs(folder: str, bits: int, documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches, folder):
            counts = _joined(row["unigrams"])
            keys, at, inverse = block.pairs()
            n = np.bincount(inverse[block.trained], minlength=len(keys)).astype(np.uint32)
            context = code(_context_counts(block, counts, documents)[at] - 1)
            token = code(counts[block.tokens[at]] - 1)
            del inverse
            for part, s in _ranges(keys, bits):
                yield pa.RecordBatch.from_pydict({"part": [part], "block": [row["block"]], "asked": [packed({"keys": keys[s], "n": n[s], "context": context[s], "token": token[s]})]})

    return run


def _answer_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    keys, total, places, asked = _totals(rows)
    context, token = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
    for at, a in zip(places, asked, strict=True):
        context[at], token[at] = a["context"], a["token"]
    out = [{"part": part, "block": block, "counts": packed({"n": total[at].astype(np.uint32)}), "key": -1, "n": 0} for part, block, at in zip(rows["part"], rows["block"], places, strict=True)]
    seen = total > 0
    kinds = context[seen].astype(np.int64) << 16 | code(total[seen] - 1).astype(np.int64) << 8 | token[seen]
    kinds, at = np.unique(kinds, return_inverse=True)
    n = np.bincount(at, weights=total[seen], minlength=len(kinds)).astype(np.int64)
    out += [{"part": rows["part"].iloc[0], "block": None, "counts": None, "key": k, "n": c} for k, c in zip(kinds.tolist(), n.tolist(), strict=True)]
    return pd.DataFrame(out)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(folder: str, n: int, v: int, documents: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches, folder):
            counts, pairs = _joined(row["unigrams"]), _joined(row["bigrams"])
            inverse = block.pairs()[2]
            c = counts[block.tokens]
            seen = _context_counts(block, counts, documents)
            w = weights[bucket(code(seen))]
            p = w[:, 0] * pairs[inverse] / np.maximum(seen, 1) + w[:, 1] * c / max(1, n) + w[:, 2] / (v + 1)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

            def summed(x: np.ndarray, of=block.of, size=len(block.lengths)) -> np.ndarray:
                return np.bincount(of, weights=x, minlength=size)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, mask=block.null.astype(bool)),
                    pa.array(block.held.astype(bool)),
                    pa.array(block.lengths),
                    pa.array(summed(c > 0).astype(np.int64)),
                    pa.array(summed(base)),
                    pa.array(summed(np.log10(p))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held_out: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Learns from documents whose remainder is not held_out. A null text is empty and still has its end token; a null id has an
    empty text, so its remainder is 0; repeated rows count each time; an empty table gives an empty result, and one without
    training documents scores by the uniform share alone.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lm-blocks")
    blocks = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(folder, held_out, block_tokens), "block string, tokens long, kinds long, trained long"))
    tokens, kinds, documents = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("kinds"), F.sum("trained")).first())

    def bits(keys: int) -> int:
        return max(3, math.ceil(math.log2(keys / RANGE_KEYS + 1)))

    names = blocks.select("block").repartition("block")
    asked = names.mapInArrow(_ask_tokens(folder, bits(kinds)), ASKED)
    answers = cut(asked.groupBy("part").applyInPandas(_answer_tokens, "part long, block string, counts binary, tokens long, kinds long"))
    n, v = (x or 0 for x in answers.where("block IS NULL").agg(F.sum("tokens"), F.sum("kinds")).first())

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias(name))

    unigrams = gathered(answers, "unigrams")
    asked = names.join(unigrams, "block").mapInArrow(_ask_pairs(folder, bits(tokens), documents), ASKED)
    replies = cut(asked.groupBy("part").applyInPandas(_answer_pairs, "part long, block string, counts binary, key long, n long"))
    events = replies.where("block IS NULL").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # three codes: bounded
    key = events["key"].to_numpy(np.int64)
    events = pd.DataFrame({"context": (key >> 16).astype(np.uint8), "pair": (key >> 8 & 255).astype(np.uint8), "token": (key & 255).astype(np.uint8), "n": events["n"]})
    weights = fit_weights(events, n, v)
    whole = names.join(unigrams, "block").join(gathered(replies, "bigrams"), "block")
    return whole.mapInArrow(_score(folder, n, v, documents, weights), SCORES).withColumn("train_tokens", F.lit(n).cast("long"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
