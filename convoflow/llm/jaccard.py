"""N-gram Jaccard join by T-occurrence search.

Documents with the same set of shingles are one class from the start. Two classes of sizes s and t can only reach the
similarity if they share T = ceil(r / (1 + r) * (s + t)) shingles, so in any common order of all shingles k of them lie among
the first s - ceil(r * s) + k of each. The order is by corpus frequency: the inverted lists that are built and joined are those
of rare shingles, while the lists of passages and boilerplate that many share are never walked. The order comes from a sketch
of frequencies over all documents, of fixed size; it only orders, so its errors cost time and never a link.

Lists of the same members are one with a weight. In lists of up to SMALL members occurrences are counted pair by pair, and k of
them make a candidate. Classes that longer lists tie together (large groups of near copies) are a family: all are first checked
against the one that is in most lists, and then, block by block, those that are still apart against each other; pairs of a
family are never rows, only the links found are. A check is
DivideSkip: the candidates' inverted lists are parted into long and short ones, the short ones heap-merged, and only candidates
with enough occurrences there are looked up in the long ones by binary search, until T is reached or out of reach.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, small_batches, table, text_runs, tidy, words
from .graph import components

WORDS, PERCENT = 5, 80
SKETCH_BITS, SKETCH_BLOCKS = 23, 64
SMALL, FAMILY_BLOCK = 64, 128
#: DivideSkip's trade-off between merging and probing.
MU = 0.01
NO_ID = -(1 << 63)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; one for a shorter text, none for one without words."""
    found = words(text and text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < n:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:z]) for a, z in zip(starts[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64))


def class_of(hashes: np.ndarray) -> int:
    """64 bits, signed, that stand for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))).astype(np.int64))


def least_overlap(size: int, percent: int) -> int:
    """ceil(size * percent / 100)"""
    return -(-size * percent // 100)


def occurrences_needed(size):
    """Short lists that two linked classes share at least, if neither has fewer shingles."""
    return np.clip(size // 16, 1, 8)


def _first_pass(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of kind 0 for each document, and the task's counts of shingles in rows of kind 1."""
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            sizes, classes = [], []
            for run_ in text_runs(batch.column(1)):
                fresh = []
                for text in run_:
                    h = shingles(text, n)
                    sizes.append(len(h))
                    classes.append(c := class_of(h) if len(h) else 0)
                    if c not in seen:
                        seen.add(c)
                        fresh.append(h)
                if fresh:
                    np.add.at(counts, (np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], ["doc_id", "n_shingles", "class", "block", "counts"])
            tidy()
        for block, part in enumerate(np.split(counts, SKETCH_BLOCKS)):
            if part.any():
                packed = zlib.compress(np.minimum(part, 65535).astype("<u2").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["doc_id", "n_shingles", "class", "block", "counts"])
        del counts, part
        tidy()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch blocks of a partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(counts.as_py()), "<u2").astype(np.int64)
            held[block] = held[block] + part if block in held else part
    for block, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(part, 65535).astype("<u2").tobytes()], pa.binary())], ["block", "counts"])


def frequency_sketch(first: DataFrame) -> np.ndarray:
    """Counts by the leading bits of a shingle's hash, 16 MB however large the corpus is."""
    blocks = first.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_add_up, "block int, counts binary").collect()
    sketch = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint16)
    for row in blocks:
        sketch[row["block"]] = np.frombuffer(row["counts"], "<u2")
    return sketch.ravel()


def rare_first(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The hashes in one order that all documents share: by estimated frequency, then by value."""
    estimate = sketch[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return hashes[np.argsort(estimate << np.uint64(48) | hashes >> np.uint64(16), kind="stable")]


def _prefixes(n: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """shingle, class, size for the prefix of each class, once a task."""
        seen: set[int] = set()
        for batch in batches:
            for run_ in text_runs(batch.column(0)):
                keys, classes, sizes = [], [], []
                for text in run_:
                    h = shingles(text, n)
                    if not len(h) or (c := class_of(h)) in seen:
                        continue
                    seen.add(c)
                    keys.append(rare_first(h, sketch.value)[: len(h) - least_overlap(len(h), percent) + int(occurrences_needed(len(h)))])
                    classes.append(np.full(len(keys[-1]), c, np.int64))
                    sizes.append(np.full(len(keys[-1]), len(h), np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], ["shingle", "class", "size"])
            tidy()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of two classes and more; rows come sorted by shingle. n: the shingles of a stretch that have these members."""
    rest: tuple[np.ndarray, ...] | None = None

    def lists(keys: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        found: dict[bytes, list] = {}
        many = ends - starts > 1
        for a, z in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            members, at = np.unique(classes[a:z], return_index=True)
            if len(members) > 1:
                if (name := members.tobytes()) in found:
                    found[name][2] += 1
                else:
                    found[name] = [members, sizes[a:z][at], 1]
        if not found:
            return None
        columns = list(zip(*found.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.int64())], ["members", "sizes", "n"])

    for batch in batches:
        columns = tuple(c.to_numpy() for c in batch.columns)
        if rest is not None:
            columns = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on in the next batch
        rest = tuple(c[last:].copy() for c in columns)
        if (found := lists(*(c[:last] for c in columns))) is not None:
            yield found
    if rest is not None and (found := lists(*rest)) is not None:
        yield found


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[bool]:
    """Which of the candidates (sorted distinct hashes, like the query) reach the similarity."""
    needed = [-(-percent * (len(query) + len(c)) // (100 + percent)) for c in candidates]
    # Inverted lists: which candidates hold each of the query's shingles.
    held = np.concatenate(candidates) if candidates else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    at = np.searchsorted(query, held)
    hit = (at < len(query)) & (query[np.minimum(at, len(query) - 1)] == held) if len(query) else np.zeros(len(held), bool)
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(at)))
    least = min(needed, default=0)
    longest = int(lengths.max(initial=1))
    n_long = min(len(lengths), max(0, least - 1), int(least / (MU * math.log2(longest) + 1)))
    by_length = np.argsort(-lengths, kind="stable")
    long, short = by_length[:n_long], by_length[n_long:]
    merged = heapq.merge(*(owner[starts[i] : starts[i] + lengths[i]].tolist() for i in short))
    found = {c: sum(1 for _ in same) for c, same in groupby(merged)}
    # Binary probes of the long lists: their shingles, in the candidate's own sorted array, a stretch at a time.
    probes = query[at[starts[np.sort(long)]]] if n_long else np.zeros(0, np.uint64)
    out = []
    for c, (hashes, need) in enumerate(zip(candidates, needed, strict=True)):
        count, left = found.get(c, 0), len(probes)
        while count < need <= count + left:
            part = probes[len(probes) - left :][:256]
            place = np.minimum(np.searchsorted(hashes, part), len(hashes) - 1)
            count += int((hashes[place] == part).sum())
            left -= len(part)
        out.append(count >= need)
    return out


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, linked for rows (a, b, text_a, text_b); rows of one a are searched together."""
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            order = np.argsort(a, kind="stable")
            linked = np.zeros(len(a), bool)
            cuts = [0, *(np.flatnonzero(np.diff(a[order])) + 1).tolist(), len(a)]
            for i, z in zip(cuts[:-1], cuts[1:], strict=True):
                query = shingles(batch.column(2)[int(order[i])].as_py(), n)
                for k in range(i, z, 128):
                    rows = order[k : min(k + 128, z)]
                    linked[rows] = divide_skip(query, [shingles(batch.column(3)[int(r)].as_py(), n) for r in rows], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])
            tidy()

    return run


def _counted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, needed, n: the pairs of short lists whose sizes allow a link, with the shingles they share there."""
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for members, sizes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members, sizes = np.array(members, np.int64), np.array(sizes, np.int64)
                i, j = np.triu_indices(len(members), 1)
                low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
                fits = 100 * low >= percent * high
                for column, values in zip(out, (members[i], members[j], occurrences_needed(low), np.full(len(i), n)), strict=True):
                    column.append(values[fits])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["a", "b", "needed", "n"])

    return run


def _apart(n: int, percent: int):
    """Links between classes of two blocks of a family whose labels differ, as few as connect what can be connected."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], kind="stable").drop_duplicates("node")
        nodes, sides = rows["node"].to_numpy(np.int64), rows["side"].to_numpy()
        sets = [shingles(t, n) for t in rows["text"]]
        sizes = np.array([len(h) for h in sets])
        label = np.unique(rows["label"].to_numpy(np.int64), return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        inside = not (sides == 1).any()  # a block with itself
        for i in range(len(nodes)):
            others = np.arange(i + 1, len(nodes)) if inside else np.flatnonzero(sides == 1) if sides[i] == 0 else np.zeros(0, int)
            fits = 100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
            others = others[fits & (label[others] != label[i])]
            if not len(others):
                continue
            for j, linked in zip(others.tolist(), divide_skip(sets[i], [sets[j] for j in others], percent), strict=True):
                if linked and label[j] != label[i]:
                    out.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
        tidy()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _family_links(families: DataFrame, texts: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame:
    """families (family, node), labels (node, label) -> a, b: links between members that labels leave apart."""
    named = families.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("family", "m")
    named = named.join(mixed, "family")
    # Ranges of labels are blocks: a hash of the family's largest component alone fills blocks that need no look at each other.
    parts = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"))
    named = named.join(parts, ["family", "label"])
    large = F.col("k") > FAMILY_BLOCK
    split = F.ceil(F.when(large, F.col("k")).otherwise(F.col("m")) / FAMILY_BLOCK)
    block = F.when(large, F.xxhash64("label", F.pmod(F.xxhash64("node"), split))).otherwise(F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("label"), split)))
    placed = cut(named.withColumn("block", block).select("family", "node", "label", "block"))
    blocks = placed.groupBy("family", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    i, j = blocks.alias("i"), blocks.alias("j")
    apart = (F.col("i.lo") != F.col("i.hi")) | (F.col("j.lo") != F.col("j.hi")) | (F.col("i.lo") != F.col("j.lo"))
    pairs = cut(i.join(j, F.col("i.family") == F.col("j.family")).where((F.col("i.block") <= F.col("j.block")) & apart).select(F.col("i.family").alias("family"), F.col("i.block").alias("i"), F.col("j.block").alias("j")))
    held = placed.join(texts.select(F.col("class").alias("node"), "text"), "node")
    first = held.join(pairs.withColumn("block", F.col("i")), ["family", "block"]).withColumn("side", F.lit(0))
    second = held.join(pairs.where("i <> j").withColumn("block", F.col("j")), ["family", "block"]).withColumn("side", F.lit(1))
    columns = ["family", "i", "j", "side", "node", "label", "text"]
    return first.select(*columns).unionByName(second.select(*columns)).groupBy("family", "i", "j").applyInPandas(_apart(n, percent), "a long, b long")


BLOOM_BITS = 1 << 26


def _bloom_bits(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(38)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for batch in batches:
        at = _bloom_bits(batch.column(0).to_numpy())
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for block, part in enumerate(np.split(bits, SKETCH_BLOCKS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "bits"])


def _or_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
            held[block] = held[block] | part if block in held else part
    for block, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "bits"])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash, 8 MB however many there are: says of other ids, mostly, that they are not among these."""
    found = ids.mapInArrow(_bitmap, "block int, bits binary").repartition("block").mapInArrow(_or_up, "block int, bits binary").collect()
    bits = np.zeros((SKETCH_BLOCKS, BLOOM_BITS // 8 // SKETCH_BLOCKS), np.uint8)
    for row in found:
        bits[row["block"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return bits.ravel()


def _texts(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class and text of the documents that may be wanted, one of a class in each task."""
        seen: set[int] = set()
        for batch in batches:
            at = _bloom_bits(batch.column(0).to_numpy())
            mine = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for run_ in text_runs(mine.column(1)):
                found: dict[int, str] = {}
                for text in run_:
                    h = shingles(text, n)
                    if len(h) and (c := class_of(h)) not in seen:
                        seen.add(c)
                        found[c] = text
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["class", "text"])
            tidy()

    return run


def _checked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs (a, b) -> a, b, linked. A hub that is in very many pairs is spread over tasks by its partners."""
    texts = texts.groupBy("class").agg(F.min("text").alias("text"))
    whole = lookup(pairs, texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), ["a"], ["b"], "inner", wide=True)
    whole = whole.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(whole.select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long, linked boolean"))


def jaccard_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> documents (doc_id, n_shingles, class), and links (a, b) that connect all classes that hang together.

    links holds no pair that fails, and of those that hold it leaves out only pairs already connected by others. A null text
    or one without words is of no class (0) and has no links; null ids are allowed; rows that repeat share a class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    first = cut(rows.mapInArrow(_first_pass(n), "doc_id long, n_shingles long, class long, block int, counts binary"))
    documents = first.where("block IS NULL").select("doc_id", "n_shingles", "class")
    sketch = spark.sparkContext.broadcast(frequency_sketch(first))
    prefixes = rows.select("text").mapInArrow(_prefixes(n, percent, sketch), "shingle long, class long, size int")
    lists = prefixes.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_lists, "members array<long>, sizes array<int>, n long")
    lists = cut(lists.groupBy("members", "sizes").agg(F.sum("n").alias("n")))
    short, long = lists.where(F.size("members") <= SMALL), lists.where(F.size("members") > SMALL)
    counted = short.mapInArrow(_counted(percent), "a long, b long, needed long, n long").groupBy("a", "b", "needed").agg(F.sum("n").alias("n"))
    member = long.select(F.element_at("members", 1).alias("a"), "n", F.explode(F.arrays_zip("members", "sizes")).alias("m")).select("a", F.col("m.members").alias("node"), F.col("m.sizes").alias("size"), "n")
    weight = member.groupBy("node").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    family = components(member.select("a", F.col("node").alias("b"))).withColumnRenamed("label", "family")
    families = cut(weight.join(family, "node"))
    hubs = families.groupBy("family").agg(F.max(F.struct("n", "node", "size")).alias("h"))
    fits = 100 * F.least("size", "h.size") >= percent * F.greatest("size", "h.size")
    stars = families.join(hubs, "family").where(fits & (F.col("node") != F.col("h.node"))).select(F.col("h.node").alias("a"), F.col("node").alias("b"))
    pairs = cut(counted.where("n >= needed").select("a", "b").unionByName(stars).distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(families.select(F.col("node").alias("class"))).distinct()
    # One row a class before the join: a class of very many copies is no hot key.
    ids = documents.groupBy("class").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id")).join(involved, "class", "left_semi")
    wanted = spark.sparkContext.broadcast(id_filter(ids.select("doc_id")))
    known = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    texts = cut(known.mapInArrow(_texts(n, wanted), "class long, text string"))
    checked = _checked(pairs, texts, n, percent)
    links = checked.where("linked").select("a", "b")
    more = _family_links(families.select("family", "node"), texts, cut(components(links)), n, percent)
    return documents, links.unionByName(more)


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, class, component_id: the least id that links lead to, the document's own included.

    A document without words is a component of its own. Null ids come last: a component of nothing else has a null id. An empty
    table gives an empty result.
    """
    documents, component = _labelled(docs, n, percent)
    joined = lookup(documents.where("n_shingles > 0"), component.select("class", "component"), ["class"], ["doc_id"], "inner").select("doc_id", "n_shingles", "class", F.col("component").alias("component_id"))
    return joined.unionByName(documents.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> documents (doc_id, n_shingles, class), and class, label (one for each component), component (its least id)."""
    documents, links = jaccard_links(docs, n, percent)
    least = documents.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    labels = components(links).withColumnRenamed("node", "class")
    named = cut(least.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))
    whole = named.groupBy("label").agg(F.min("least").alias("component"))
    return documents, cut(lookup(named, cut(whole), ["label"], ["class"], "inner").select("class", "label", "component"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each group of near copies; the one with the least id stays, with all its columns.

    Documents without words stay. Null ids come last, and ids may repeat: among rows of the least id (or none) one stays. Only
    documents that a filter of fixed size cannot clear are joined with what goes, so most texts are not shuffled.
    """
    docs = docs.drop("_listed", "_class")
    documents, component = _labelled(docs, n, percent)
    counted = documents.where("n_shingles > 0").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("rows"))
    found = cut(lookup(counted, component.select("class", "label"), ["class"], ["doc_id"], "inner"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("first"))
    # Ids and classes of which one row or none stays: all but the least of a component go.
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class"))
    marked = cut(lookup(found, cut(first), ["label"], ["class", "doc_id"], "inner").withColumn("stays", stays).where("NOT stays OR rows > 1").select("doc_id", "class", "stays"))
    gone = marked.where("NOT stays").select("doc_id", "class")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(marked.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct()))

    def marks(ids: pa.Array) -> np.ndarray:
        at = _bloom_bits(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False))
        return (bits.value[at >> 3] >> (at & 7) & 1).astype(bool)

    def listed(ids: pa.Array) -> pa.Array:
        return pa.array(marks(ids))

    def classes(ids: pa.Array, texts: pa.Array) -> pa.Array:
        mine = pa.array(marks(ids))
        held = (shingles(text, n) for run_ in text_runs(texts.filter(mine)) for text in run_)
        found = iter([class_of(h) if len(h) else None for h in held])
        tidy()
        return pa.StructArray.from_arrays([mine, pa.array([next(found) if m else None for m in mine.to_pylist()], pa.int64())], ["listed", "class"])

    clear = docs.where(~F.arrow_udf(listed, "boolean")(F.col("doc_id").cast("long")))
    # Both in one function, which no filter parts: a second Python worker beside each task's first takes memory until it idles out.
    both = F.arrow_udf(classes, "struct<listed: boolean, class: bigint>").asNondeterministic()
    rest = docs.withColumn("_listed", both(F.col("doc_id").cast("long"), F.col("text"))).where("_listed.listed")
    rest = cut(rest.withColumn("_class", F.col("_listed.class")).drop("_listed"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.col("d._class") == F.col("g.class"))
    stay = rest.where("_class IS NOT NULL").alias("d").join(gone.alias("g"), same, "left_anti").dropDuplicates(["doc_id", "_class"])
    return clear.unionByName(stay.drop("_class")).unionByName(rest.where("_class IS NULL").drop("_class"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Whole sets against whole sets: right for any table, and quick for small ones.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
