"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by a grouping genetic algorithm.

A solution is a grouping of pieces into bins. Crossover takes whole well-filled bins of one parent into the other, removes the
bins there that hold one of their pieces a second time, and best-fits the pieces so displaced. Pieces are dealt to shards;
each shard is evolved on several islands, whose elites then migrate to one another and evolve on together. Bins that a shard
fills well are settled, and the fuller half in any case; pieces of the others move on to shards of the next, smaller round,
until all that is left is one shard. So half-filled bins of all shards meet, and the number of rounds is that of halvings.

Where best fit is within a bin of the lower bound there is nothing to evolve: the bin that is not full moves on.

Only pieces shorter than the capacity are packed; a full piece is a sequence. What is dealt out is one narrow row a piece,
never text, and a shard holds about ISLAND_PIECES rows however large the input is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_runs, tidy
from .tokens import CACHE_PIECES as ENCODER_PIECES
from .tokens import Encoder, default_tokenizer, kept_encoder

CAPACITY = 1024
ISLAND_PIECES = 8192
ISLANDS = 2
POPULATION = 8
#: Generations at most, and those without a better grouping after which an island ends.
GENERATIONS, PATIENCE = 60, 4
#: A bin that is filled to this share is settled.
SETTLED = 0.995

#: Text pieces that are remembered while documents are encoded: less than the encoder would by itself, as packing often ends
#: a pipeline whose executors are already full.
CACHE_PIECES = 150_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 2, cache_pieces: int = CACHE_PIECES, keep: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32. Only longer documents are cut; their first piece may be shorter.

    A null text is empty and still has its end id; null ids stay null; rows that repeat are cut each for itself, so their pieces
    repeat; an empty table gives no pieces. Other columns are not read. With `keep` a Python worker holds what it remembers until its
    next task, which saves time and takes the memory in between.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = (kept_encoder if keep else Encoder)(tokenizer, cache_pieces)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            done = 0
            for part in map(encoder, text_runs(batch.column(1))):
                at, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(part, done):
                    wide = np.frombuffer(ids + end, encoder.dtype).astype("<u4")
                    edges = [0, *range(len(wide) % capacity or capacity, len(wide) + 1, capacity)] if len(wide) > capacity else [0, len(wide)]
                    for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        at.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(wide[a:z].tobytes()))
                done += len(part)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
            tidy()
        del encoder
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


class Bins:
    """Open bins by room left, for best fit: the fullest bin that still takes a piece is found by one bit operation."""

    def __init__(self, capacity: int, rooms: list[int]):
        self.rooms = rooms
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.open = capacity, 0
        for b, room in enumerate(rooms):
            self._put(b, room)

    def _put(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.open |= 1 << room

    def place(self, length: int) -> int:
        fits = self.open >> length
        if not fits:
            self.rooms.append(self.capacity - length)
            self._put(len(self.rooms) - 1, self.capacity - length)
            return len(self.rooms) - 1
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        b = held.pop()
        if not held:
            self.open &= ~(1 << room)
        self.rooms[b] = room - length
        self._put(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray | None = None, fills: np.ndarray | None = None) -> np.ndarray:
    """Places the pieces in `order` into the bins that `bins` and `fills` describe, or into new ones; returns every piece's bin."""
    out = np.full(len(lengths), -1, np.int64) if bins is None else bins
    held = Bins(capacity, [] if fills is None else (capacity - fills).tolist())
    out[order] = [held.place(n) for n in lengths[order].tolist()]
    return out


def fill_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: those leave room that can still be used."""
    fills = fill_of(lengths, bins)
    fills = fills[fills > 0]
    return -len(fills), float(((fills / capacity) ** 2).mean()) if len(fills) else 0.0


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """taker with whole bins of giver's fullest in it."""
    fills = fill_of(lengths, giver)
    full = np.flatnonzero(fills >= np.quantile(fills[fills > 0], 0.5))
    given = rng.random(len(fills)) < 0.3
    chosen = np.zeros(len(fills), bool)
    chosen[full] = given[full]
    moved = chosen[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[moved]] = True
    child = np.where(moved, giver + len(broken), np.where(broken[taker], -1, taker))
    loose = np.flatnonzero(child < 0)
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    held = np.bincount(child[kept], weights=lengths[kept]).astype(np.int64)
    order = loose[np.argsort(-lengths[loose] + rng.integers(0, 24, len(loose)), kind="stable")]
    return best_fit(lengths, order, capacity, child, held)


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray] = (), enough: int = 0, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The best grouping found: elites and noisy best-fit-decreasing groupings at first, then the worst gives way to each better child.

    Ends with the generations, with PATIENCE of them without a better grouping, or `enough` bins above the lower bound.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity) + enough
    crowd = list(elites) or [best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    scores = [fitness(lengths, c, capacity) for c in crowd]
    if -max(scores)[0] <= least:
        return crowd[scores.index(max(scores))]
    while len(crowd) < max(2, population):
        noise = rng.integers(0, 65, len(lengths))
        crowd.append(best_fit(lengths, np.argsort(-lengths + noise, kind="stable"), capacity))
        scores.append(fitness(lengths, crowd[-1], capacity))
    best, waited = max(scores), 0
    while -best[0] > least and waited < PATIENCE and generations > 0:
        for _ in range(len(crowd)):
            a, b = rng.choice(len(crowd), 2, replace=False)
            if scores[a] < scores[b]:
                a, b = b, a
            child = crossover(lengths, crowd[a], crowd[b], capacity, rng)
            score, worst = fitness(lengths, child, capacity), min(range(len(crowd)), key=scores.__getitem__)
            if score > scores[worst]:
                crowd[worst], scores[worst] = child, score
        generations -= 1
        waited = 0 if max(scores) > best else waited + 1
        best = max(best, *scores)
    return crowd[max(range(len(crowd)), key=scores.__getitem__)]


def _island(capacity: int, seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One island's elite: a bin for every piece of its shard."""
        rows = rows.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins = evolve(rows["length"].to_numpy(np.int64), capacity, seed + int(rows["island"].iloc[0]), enough=0 if last else 1)
        return rows.assign(bin=bins)

    return run


def _migrated(capacity: int, seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The elites of a shard's islands meet, evolve on, and the best is kept; `settled` bins are done."""
        rows = rows.sort_values(["island", "length", "item"], ascending=[True, False, True], kind="stable")
        islands = [part for _, part in rows.groupby("island", sort=True)]
        first = islands[0]
        lengths = first["length"].to_numpy(np.int64)
        bins = evolve(lengths, capacity, seed - 1, [p["bin"].to_numpy(np.int64) for p in islands], 0 if last else 1)
        bins = np.unique(bins, return_inverse=True)[1]
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        opens = np.concatenate([[0], ends[:-1]])
        heads = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = opens - np.repeat(opens[heads], np.diff([*heads, len(order)]))
        fills = fill_of(lengths, bins)
        settled = fills[bins] >= (0 if last else min(SETTLED * capacity, np.median(fills)))
        return first[[c for c in first if c not in ("island", "bin")]].assign(bin=bins, offset=offset, settled=settled)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, islands: int = ISLANDS, seed: int = 29) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32; length from 1 to capacity) -> plus sequence_id and offset.

    Every row is placed once; repeated rows and null ids are rows like any other; an empty table gives an empty result.
    """
    parts = cut(parts.select("doc_id", "piece", "start", "length", "ids_crc32"))
    schema = f"{PIECE}, no_id boolean, item long"
    # pandas would make floats of ids among nulls.
    numbered = parts.withColumns({"item": F.monotonically_increasing_id(), "no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    columns = [*parts.columns, "no_id"]
    full = F.col("length") >= capacity
    done = [numbered.where(full).select(*columns, (F.lit(1 << 62) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = numbered.where(~full)
    count, round_no = left.count(), 0
    while count:
        shards = -(-count // island_pieces)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(shards)))
        copies = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        elites = copies.groupBy("shard", "island").applyInPandas(_island(capacity, seed + 1000 * round_no, shards == 1), f"{schema}, shard long, island int, bin long")
        best = elites.groupBy("shard").applyInPandas(_migrated(capacity, seed + 1000 * round_no, shards == 1), f"{schema}, shard long, bin long, offset long, settled boolean")
        best = cut(best)
        number = F.lit(round_no << 56) + F.shiftleft("shard", 24) + F.col("bin")
        done.append(best.where("settled").select(*columns, number.alias("sequence_id"), "offset"))
        left, round_no = best.where("NOT settled").select(*columns, "item"), round_no + 1
        count = left.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), cache_pieces=ENCODER_PIECES, keep=True))
