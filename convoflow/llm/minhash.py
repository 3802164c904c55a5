"""Near-duplicate detection by one-permutation hashing.

A document's shingle hashes are dealt into BINS bins by one hash; the least hash of each bin is its component of the signature,
and an empty bin borrows that of a bin which the same fixed sequence of probes finds for every document (optimal densification).
ROWS components make a band, a band's value is a bucket, and documents of equal sets are one class from the start. A bucket gives
the star between its least class and the others, never its pairs, and each edge is confirmed on the full sets of both ends.

A star that does not hold (its hub is unlike some member) leaves a bucket whose members are still apart. Those, and only those,
are looked at again: buckets of up to SMALL classes by the pairs that are apart. A larger one mostly holds documents that a common
passage ties together, whose pairs would be the square of their number; all classes of such buckets are joined once by the exact
T-occurrence search of `jaccard`, which walks no list of a common shingle. So no bucket loses a link between two of its members,
however large it is. A pair of similarity 0.8 shares no bucket at all with a probability of about
(1 - 0.8 ** ROWS) ** (BINS / ROWS), 5 in 10 million here; pairs that are more alike, by less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lookup, small_batches, stored, table, text_runs, tidy
from .graph import components
from .jaccard import PERCENT, _bloom_bits, _texts, class_of, id_filter, jaccard_links, shingles

WORDS, BINS, ROWS = 2, 288, 6
#: Classes of an unresolved bucket up to which its pairs that are apart are listed; those of larger ones are joined exactly.
SMALL = 8
#: Partners of a hub that are compared with it in one place.
PARTNERS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def probes(bins: np.ndarray, first: int, n: int, k: int) -> np.ndarray:
    """n x len(bins): where each bin looks for a value, from its attempt `first` on; the same for all documents."""
    attempts = np.arange(first, first + n, dtype=np.uint64)[:, None]
    return (_mixed(bins.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + attempts * np.uint64(0xD1B54A32D192ED03)) % np.uint64(k)).astype(np.int64)


def signature(hashes: np.ndarray, k: int = BINS) -> np.ndarray:
    """The k components of sorted distinct 64-bit hashes, of which there is one at least."""
    at = ((hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # hashes come sorted, so bins do
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    filled = np.zeros(k, bool)
    filled[at[first]] = True
    values = np.zeros(k, np.uint64)
    values[at[first]] = hashes[first]
    empty, tried = np.flatnonzero(~filled), 0
    while len(empty):
        places = probes(empty, tried, 64, k)
        hit = filled[places]
        found = hit.any(axis=0)
        values[empty[found]] = values[places[hit.argmax(axis=0)[found], np.flatnonzero(found)]]
        empty, tried = empty[~found], tried + 64
    return values


def buckets(hashes: np.ndarray, k: int = BINS, rows: int = ROWS) -> list[int]:
    """A bucket for each band of the signature, as signed 64-bit numbers that tell the bands apart."""
    bands = signature(hashes, k)[: k // rows * rows].astype("<u8").reshape(-1, rows)
    keys = np.array([xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(bands)], np.uint64)
    return keys.astype(np.int64).tolist()


def _first_pass(n: int, k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, n_shingles, class; buckets once for a class in each task."""
        seen: set[int] = set()
        for batch in batches:
            sizes, classes, keys = [], [], []
            for part in text_runs(batch.column(1)):
                for text in part:
                    h = shingles(text, n)
                    sizes.append(len(h))
                    classes.append(c := class_of(h) if len(h) else 0)
                    new = len(h) and c not in seen
                    seen.add(c)
                    keys.append(buckets(h, k, rows) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class", "buckets"])
            tidy()

    return run


def _sets(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class and hashes (sorted 64-bit numbers) of the documents that may be wanted, one of a class in each task."""
        seen: set[int] = set()
        for batch in batches:
            at = _bloom_bits(batch.column(0).to_numpy())
            mine = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in text_runs(mine.column(1)):
                found: dict[int, bytes] = {}
                for text in part:
                    h = shingles(text, n)
                    if len(h) and (c := class_of(h)) not in seen:
                        seen.add(c)
                        found[c] = h.tobytes()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["class", "hashes"])
            tidy()

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b of the rows (a, salt, side, class, hashes) that reach the similarity with their hub, which comes before them (side 0)."""
        key, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for i, (a, salt, side) in enumerate(rows):
                hashes = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if not side:
                    key, hub = (a, salt), hashes.copy()
                elif key == (a, salt):
                    shared = len(np.intersect1d(hub, hashes, assume_unique=True))
                    linked[i] = 100 * shared >= percent * (len(hub) + len(hashes) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(linked))
            tidy()

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold. Sets go to the hubs of their pairs; a hub of very many is sent to several tasks, to some of its partners each."""
    salts = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts")))
    partners = lookup(pairs, salts, ["a"], ["b"], "inner").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("side"), F.col("b").alias("class"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    hubs = salts.select("a", every.alias("salt"), F.lit(0).alias("side"), F.col("a").alias("class"))
    whole = partners.unionByName(hubs).join(sets, "class").select("a", "salt", "side", "class", "hashes")
    return cut(whole.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(_confirmed(percent), "a long, b long"))


def _fits(percent: int, a: str, b: str):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def minhash_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, k: int = BINS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> documents (doc_id, n_shingles, class), and confirmed links (a, b) between classes.

    Of the links among the classes of one bucket it leaves out only those whose ends are connected by others. A null text, an
    empty one and one without words is of no class (0) and has no links; null ids are allowed; rows that repeat, and texts of
    equal sets, share a class; long texts are taken whole; other columns are not read; an empty table gives empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col("doc_id").cast("long"), "text")
    first = stored(read.mapInArrow(_first_pass(n, k, rows), "doc_id long, n_shingles long, class long, buckets array<long>"), "minhash")
    documents = first.select("doc_id", "n_shingles", "class")
    # One row a class before its buckets are spread out, so copies in many tasks do not multiply them.
    classes = first.where("buckets IS NOT NULL").groupBy("class").agg(F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets"))
    members = stored(classes, "classes").select("class", "size", F.explode("buckets").alias("bucket"))
    # Members travel once, whatever their number: along a bucket its least class comes first. A bucket has a narrow row a class.
    along = Window.partitionBy("bucket").orderBy("class")
    placed = members.withColumns({"hub": F.first(F.struct("class", "size")).over(along), "next": F.lead("class").over(along)})
    shared = stored(placed.where("next IS NOT NULL OR class <> hub.class").select("bucket", "class", "size", "hub"), "buckets")
    stars = shared.where(F.col("class") != F.col("hub.class")).where(_fits(percent, "size", "hub.size"))
    stars = cut(stars.select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct())
    ids = cut(documents.where("n_shingles > 0").groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("doc_id")).join(shared.select("class").distinct(), "class", "left_semi"))
    known = read.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")
    wanted = spark.sparkContext.broadcast(id_filter(ids.select("doc_id")))
    one = stored(known.mapInArrow(_sets(n, wanted), "class long, hashes binary").groupBy("class").agg(F.min("hashes").alias("hashes")), "sets")
    links = _confirm(stars, one, percent)
    # What the stars leave apart: buckets with classes of more than one label.
    labels = cut(components(links))
    named = lookup(shared.select("bucket", "class", "size"), labels.select(F.col("node").alias("class"), "label"), ["class"], ["bucket"]).withColumn("label", F.coalesce("label", "class"))
    named = stored(named, "labels")
    tally = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"))
    # Buckets of the same classes are one.
    tally = cut(tally.where("lo <> hi").groupBy("who", "m").agg(F.min("bucket").alias("bucket")).select("bucket", "m"))
    small = named.join(tally.where(F.col("m") <= SMALL), "bucket")
    i, j = small.alias("i"), small.alias("j")
    apart = (F.col("i.bucket") == F.col("j.bucket")) & (F.col("i.class") < F.col("j.class")) & (F.col("i.label") != F.col("j.label"))
    pairs = i.join(j, apart).where(_fits(percent, "i.size", "j.size")).select(F.col("i.class").alias("a"), F.col("j.class").alias("b")).distinct()
    links = links.unionByName(_confirm(cut(pairs.join(stars, ["a", "b"], "left_anti")), one, percent))
    crowded = cut(named.join(tally.where(F.col("m") > SMALL), "bucket", "left_semi").select("class").distinct())
    among = spark.sparkContext.broadcast(id_filter(ids.join(crowded, "class", "left_semi").select("doc_id")))
    texts = known.mapInArrow(_texts(n, among), "class long, text string").join(crowded, "class", "left_semi")
    one_each = stored(texts.groupBy("class").agg(F.min("text").alias("text")).select(F.col("class").alias("doc_id"), "text"), "crowded")
    return documents, links.unionByName(jaccard_links(one_each, n, percent)[1])


_NO_ID = -(1 << 63)


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, k: int = BINS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (the least id that links lead to, its own included), kept.

    Of each component the document with the least id is kept; rows that repeat that id are kept alike. Documents without words
    are components of their own. Null ids come last: a component of nothing else has a null id, and its rows are kept.
    """
    documents, links = minhash_links(docs, n, percent, k, rows)
    least = documents.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    labels = components(links).withColumnRenamed("node", "class")
    named = cut(least.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"))
    component = cut(lookup(named, cut(whole), ["label"], ["class"], "inner").select("class", "component_id"))
    joined = lookup(documents.where("n_shingles > 0"), component, ["class"], ["doc_id"], "inner").select("doc_id", "n_shingles", "component_id")
    found = joined.unionByName(documents.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Whole sets against whole sets: what the operator finds but for the chance stated above.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: array_to_string(list_slice(ws, i, i + 1), ' ')) END) AS g FROM w
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
