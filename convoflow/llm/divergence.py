"""How the sources of a language differ: divergence of every two of them, and the terms that make a source stand out.

Terms are counted in tasks and then by key. The kept vocabulary of a language is dealt into stripes of about STRIPE terms; within
a stripe every group (a language's source) has a vector, packed and compressed. The groups of a language sit in cells, and a
(stripe, cell) is one place where its vectors stay resident. The others circulate: in each round of a round-robin tournament
(circle method) a cell meets one other, at the place of one of the two, and a meeting is evaluated once for both directions. A
visiting vector is met and forgotten, so a place holds its own cell and one batch of visitors, whatever the corpus. The
language's own vector visits first; against it each resident keeps a heap of its terms of greatest divergence.

All arithmetic is on integers. What leaves a place is a partial sum for each ordered pair and at most TERMS terms a group.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lookup, small_batches, stored, table, tidy

#: Fixed values of the contract: scale and smoothing of shares, documents that a kept term is in, ranks of terms.
SCALE_STEPS, SMOOTH, LEAST_DOCUMENTS, TERMS = 3, 2, 10, 10
STRIPE = 4096
#: Groups of a cell: this many, or the square root of a language's groups if that is more.
CELL = 4
#: Distinct terms that a task holds before it hands its counts on.
HELD = 300_000
_LETTERS = bytes.maketrans(bytes([*range(0x41), *range(0x41, 0x5B), *range(0x5B, 0x61), *range(0x7B, 0x80)]), b" " * 0x41 + bytes(range(0x61, 0x7B)) + b" " * 11)


def terms(text: bytes, stretch: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of it at a time: runs of letters and of bytes beyond ASCII, A-Z lower-cased."""
    at = 0
    while at < len(text):
        part = text[at : at + stretch].translate(_LETTERS)
        if at + stretch < len(text):
            end = part.rfind(b" ") + 1
            while not end:  # a term longer than a stretch
                part += text[at + len(part) : at + len(part) + stretch].translate(_LETTERS)
                end = part.rfind(b" ") + 1 if at + len(part) < len(text) else len(part)
            part = part[:end]
        yield part.split()
        at += len(part)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, documents from (lang, source, text: binary), and a row with an empty term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def held() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, documents) in counts.items():
            found = [b"", *n]
            for column, values in zip(columns, ([lang] * len(found), [source] * len(found), found, [0, *n.values()], [0, *(documents[t] for t in n)]), strict=True):
                column += values
        counts.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "documents"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, documents = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for found in terms(text.as_py()):
                n.update(found)
                seen.update(found)
            documents.update(seen)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield held()
            tidy()
    yield held()


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (counts + 2) / total), exactly: a long division by steps of a thousand, for totals up to 9 * 10 ** 15."""
    whole, rest = np.divmod(np.asarray(counts, np.int64) + SMOOTH, total)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p, q):
    return (p - q) * (p - q) // (p + q)


def _pack(ids: pa.Array, counts: pa.Array) -> pa.Array:
    """Vectors (ids ascending, and their counts) as bytes: their number, steps between ids, counts, compressed."""
    out = []
    for i, n in zip(ids, counts, strict=True):
        i, n = i.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
        out.append(zlib.compress(np.diff(i, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1))
    return pa.array(out, pa.binary())


def _unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob) if blob else b""
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


def _join_terms(found: pa.Array) -> pa.Array:
    """Lists of terms, which hold no line breaks, as compressed bytes."""
    return pa.array([zlib.compress(b"\n".join(x), 1) for x in found.to_pylist()], pa.binary())


class _Resident:
    """A group's shares in a stripe of k terms: those of its own terms, and the one that all others have."""

    def __init__(self, source: str, k: int, total: int, blob: bytes | None):
        self.source, (self.ids, self.counts) = source, _unpack(blob)
        self.base = int(share(np.zeros(1, np.int64), total)[0]) if k else 0
        self.own = share(self.counts, total) if k else self.counts
        self.k = k

    def settle(self) -> _Resident:
        self.shares, self.has = np.full(self.k, self.base, np.int64), np.zeros(self.k, bool)
        self.shares[self.ids], self.has[self.ids] = self.own, True
        return self

    def meet(self, visitor: _Resident) -> int:
        """The divergence over all terms of the stripe; what neither has counts by its number."""
        if not self.k:
            return 0
        both = visitor.ids[self.has[visitor.ids]]
        total = divergence(self.shares[visitor.ids], visitor.own).sum() + divergence(self.own, visitor.base).sum() - divergence(self.shares[both], visitor.base).sum()
        return int(total) + (self.k - len(self.ids) - len(visitor.ids) + len(both)) * divergence(self.base, visitor.base)

    def stand_out(self, lang: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(value, id) of the terms that the group has more of than its language, the greatest n; ids ascend as terms do."""
        more = self.own > lang[self.ids]
        ids = self.ids[more]
        return [(-v, i) for v, i in heapq.nsmallest(n, zip((-divergence(self.own[more], lang[ids])).tolist(), ids.tolist(), strict=True))]


def _meetings(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, source, part, item, value; rows come sorted by place, and within it the language, the residents, the visitors by round."""
        place: tuple | None = None
        lang_shares, names, residents = np.zeros(0, np.int64), [], []
        for batch in batches:
            out: list[tuple] = []
            for lang, stripe, host, round_, source, total, blob, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (lang, stripe, host):
                    place, residents = (lang, stripe, host), []
                    lang_shares, names = np.zeros(0, np.int64), []
                if round_ == -2:
                    names = zlib.decompress(found).split(b"\n")
                    lang_shares = share(_unpack(blob)[1], total)
                    continue
                group = _Resident(source, len(names), total, blob)
                if round_ == -1:
                    out += [(lang, source, "term", names[i], v) for v, i in group.settle().stand_out(lang_shares, n_terms)]
                for other in residents:
                    value = other.meet(group)
                    out += [(lang, other.source, "pair", source.encode(), value), (lang, source, "pair", other.source.encode(), value)]
                if round_ == -1:
                    residents.append(group)
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])

    return run


def visits(cell: Column, cells: Column) -> Column:
    """The rounds in which a cell goes to another, with its host: an array of (round, host).

    Circle method: with an even number of seats the last one stays, and in round r seat c meets (2r - c) modulo the others; an odd
    number of cells has an empty seat. Of the two that meet, the lesser is host if their sum is even, else the greater.
    """
    others = cells + cells % 2 - 1

    def met(r: Column) -> Column:
        r = r.cast("int")
        peer = F.when(cell == others, r).when(cell == r, others).otherwise(F.pmod(2 * r - cell, others))
        host = F.when((cell + peer) % 2 == 0, F.least(cell, peer)).otherwise(F.greatest(cell, peer))
        return F.struct(r.alias("round"), F.when((peer < cells) & (host == peer), peer).alias("host"))

    rounds = F.when(cells > 1, F.transform(F.sequence(F.lit(0), others - 1), met)).otherwise(F.array())
    return F.filter(rounds, lambda m: m["host"].isNotNull())


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, n_terms: int = TERMS, stripe_terms: int = STRIPE, cell: int = CELL) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank: every group's other sources and its terms, ranked.

    Null texts, languages and sources are read as empty ones, so a null and an empty source are one group. A group without terms
    has the smoothed shares of one with no counts; where a language keeps no term every value is 0 and nothing stands out. Ties
    of value go by the item's bytes. Repeated rows count as often as they are there; long texts are read whole, a stretch at a
    time; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")] + [F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")]
    partial = docs.select(*text).mapInArrow(_counted, "lang string, source string, term binary, n long, documents long")
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms")
    named = F.length("term") > 0
    kept = counts.where(named).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).where(F.col("documents") >= least_documents)
    kept = stored(kept.select("lang", "term", "lang_n"), "vocabulary")
    groups = counts.where(~named).select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("all")), "lang", "left").fillna(0)
    cells = F.ceil(F.col("groups") / F.greatest(F.lit(cell), F.ceil(F.sqrt("groups")))).cast("int")
    langs = cut(langs.select("lang", "v", "all", F.greatest(F.lit(1), F.ceil(F.col("v") / stripe_terms)).cast("int").alias("stripes"), cells.alias("cells")))
    # A term's number is its place among its stripe's terms, so numbers ascend as terms do.
    stripe = F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int")
    dealt = lookup(kept, langs.select("lang", "stripes"), ["lang"], ["term"], "inner").select("lang", stripe.alias("stripe"), "term", "lang_n")
    number = F.row_number().over(Window.partitionBy("lang", "stripe").orderBy("term")) - 1
    dealt = stored(dealt.withColumn("id", number), "numbers")
    entries = stored(counts.where(named).select("lang", "source", "term", "n").join(dealt.select("lang", "term", "stripe", "id"), ["lang", "term"]).drop("term"), "entries")
    packed = lambda values: F.arrow_udf(_pack, "binary")(F.transform(values, lambda x: x["id"]), F.transform(values, lambda x: x["n"]))
    of_group = entries.groupBy("lang", "source", "stripe").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("vector"))
    of_group = of_group.select("lang", "source", "stripe", packed(F.col("vector")).alias("blob"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    seats = lookup(groups.join(sums, ["lang", "source"], "left"), langs, ["lang"], ["source"], "inner")
    seats = seats.withColumn("cell", F.pmod(F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, F.col("cells")).cast("int"))
    total = (F.coalesce("own", F.lit(0)) + SMOOTH * F.col("v")).alias("total")
    vectors = seats.select("lang", "source", "cell", "cells", total, F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe")).join(of_group, ["lang", "source", "stripe"], "left")
    vectors = stored(vectors, "vectors")
    columns = ["lang", "stripe", "host", "round", "source", "total", "blob", "names"]
    at_home = vectors.withColumns({"host": F.col("cell"), "round": F.lit(-1), "names": F.lit(None).cast("binary")})
    away = vectors.withColumn("visit", F.explode(visits(F.col("cell"), F.col("cells")))).withColumns({"host": F.col("visit.host"), "round": F.col("visit.round"), "names": F.lit(None).cast("binary")})
    of_lang = dealt.groupBy("lang", "stripe").agg(F.array_sort(F.collect_list(F.struct("id", "term", F.col("lang_n").alias("n")))).alias("vector"))
    names = F.arrow_udf(_join_terms, "binary")(F.transform("vector", lambda x: x["term"]))
    of_lang = lookup(of_lang.select("lang", "stripe", packed(F.col("vector")).alias("blob"), names.alias("names")), langs, ["lang"], ["stripe"], "inner")
    first = of_lang.withColumn("host", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumns({"round": F.lit(-2), "source": F.lit(None).cast("string"), "total": F.col("all") + SMOOTH * F.col("v")})
    rows = at_home.select(*columns).unionByName(away.select(*columns)).unionByName(first.select(*columns))
    places = rows.repartition("lang", "stripe", "host").sortWithinPartitions("lang", "stripe", "host", "round", "source")
    met = places.mapInArrow(_meetings(n_terms), "lang string, source string, part string, item binary, value long")
    values = met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("item", F.col("item").cast("string"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return values.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= n_terms))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


#: The same by joins of all shares, in 128-bit integers.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (SELECT i, lang, source, unnest(ts) AS term FROM d
), kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM s JOIN v USING (lang) JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f) WHERE part = 'pair' OR rank <= 10
"""
