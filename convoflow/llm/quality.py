"""Quality rules whose thresholds adapt to each language and source.

Every document is measured once; the measures of the documents that pass the base rules go into quantile sketches per language
and source. A sketch is a table of counts by bucket, whose buckets keep seven significant bits (relative error below 1/64), so
sketches merge by adding counts: partial sums within each task, then per source, per language and over everything. Each group
leans on its parents by weight, never by a switch: its distribution counts with its documents, that of its language with
PARENT_WEIGHS documents more, and within that the distribution of everything in the same way. The thresholds are then joined to
the documents, and those outside are rejected.

Only bucket counts are shuffled, never texts: a hot source is as many rows as it has buckets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, lookup, small_batches, stored, table, text_runs, tidy, words

#: Documents as which a group's parent counts in its thresholds.
PARENT_WEIGHS = 200
#: Quartile distances that a measure may lie beyond the quartiles.
REACH = 4
#: Measure, least quartile distance, and whether low values are rejected as well. Shares are in millionths, lengths in thousandths.
MEASURES = [("symbol_share", 5_000, False), ("dup_line_share", 100_000, False), ("repeat_share", 100_000, False), ("mean_word", 400, True)]
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(found) < 4:
        return 0
    windows = list(zip(found, found[1:], found[2:], strict=False))
    seen: set = set()
    again: set = set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (again if w in seen else seen).add(w)
    total, covered = 0, 0  # covered: end of what is counted
    for i, w in enumerate(windows):
        if w in again:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(found),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(found),
    )


def measures(texts: pa.Array) -> pa.Array:
    columns = [pa.array(c, pa.int64()) for c in zip(*(measure(t) for run in text_runs(texts) for t in run), strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
    out = pa.StructArray.from_arrays(columns, COUNTS)
    tidy()
    return out


def measured(docs: DataFrame) -> DataFrame:
    """docs plus a struct column `q` of counts; a null text has none of anything. A column named q is replaced."""
    small_batches(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"
    return docs.withColumn("q", F.arrow_udf(measures, kind)("text"))


def base_failed(n_words: F.Column, n_repeat_words: F.Column) -> F.Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def rates(q: F.Column) -> list[F.Column]:
    """Whole numbers, so that every engine agrees on them."""

    def share(part: F.Column, whole: F.Column, unit: int) -> F.Column:
        return F.floor(part * unit / F.greatest(whole, F.lit(1))).cast("long")

    return [
        share(q["n_symbols"], q["word_chars"], 1_000_000),
        share(q["n_dup_lines"], q["n_lines"], 1_000_000),
        share(q["n_repeat_words"], q["n_words"], 1_000_000),
        share(q["word_chars"], q["n_words"], 1_000),
    ]


def sketch(rows: DataFrame) -> DataFrame:
    """lang, source, q -> lang, source, measure, low, n: documents in each bucket that starts at low."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for (m, _, _), v in zip(MEASURES, rates(F.col("q")), strict=True)])
    long = rows.where(~base_failed(F.col("q.n_words"), F.col("q.n_repeat_words"))).select("lang", "source", F.explode(named).alias("m")).select("lang", "source", "m.*")
    drop = F.greatest(F.length(F.bin("value")) - 7, F.lit(0))
    low = F.expr("shiftleft(shiftright(value, _drop), _drop)")
    return long.withColumn("_drop", drop).withColumn("low", low).groupBy("lang", "source", "measure", "low").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, parent: int = PARENT_WEIGHS) -> DataFrame:
    """lang, source, fences: a map from measure to (least, most), one row per language and source.

    Quartiles are those of the group's distribution with its parents' weight in it; the fences lie REACH quartile distances
    beyond. The buckets of everything are a few thousand at most, as many as the number format has.
    """
    own = sketches.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("measure").alias("_m"), F.col("low").alias("_b"), F.col("n").alias("own"))
    lang = merged(sketches, ["lang"]).select(F.col("lang").alias("_pl"), F.col("measure").alias("_pm"), F.col("low").alias("_pb"), F.col("n").alias("of_lang"))
    whole = merged(sketches, []).select("measure", "low", F.col("n").alias("of_all"))
    cells = sketches.select("lang", "source", "measure").distinct().join(F.broadcast(whole), "measure")
    cells = cells.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("measure") == F.col("_m")) & (F.col("low") == F.col("_b")), "left")
    cells = cells.join(lang, F.col("lang").eqNullSafe(F.col("_pl")) & (F.col("measure") == F.col("_pm")) & (F.col("low") == F.col("_pb")), "left")
    group = Window.partitionBy("lang", "source", "measure")
    counts = ["own", "of_lang", "of_all"]
    cells = cells.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    cells = cells.withColumns({f"{c}_upto": F.sum(c).over(group.orderBy("low")).cast("double") for c in counts} | {f"{c}_sum": F.sum(c).over(group).cast("double") for c in counts})
    w = F.lit(float(parent))
    upto = F.col("own_upto") + w * (F.col("of_lang_upto") + w * F.col("of_all_upto") / F.col("of_all_sum")) / (F.col("of_lang_sum") + w)
    cells = cells.withColumn("_upto", upto).withColumn("_all", F.col("own_sum") + w)

    def quartile(k: int) -> F.Column:
        return F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("low")))

    found = cells.groupBy("lang", "source", "measure").agg(quartile(1).alias("_q1"), quartile(3).alias("_q3"))
    least_spread = F.coalesce(*[F.when(F.col("measure") == m, F.lit(u)) for m, u, _ in MEASURES])
    both = F.col("measure").isin(*[m for m, _, b in MEASURES if b])
    reach = REACH * F.greatest(F.col("_q3") - F.col("_q1"), least_spread)
    fence = F.struct(F.when(both, F.col("_q1") - reach).otherwise(F.lit(-1)).cast("long").alias("least"), (F.col("_q3") + reach).cast("long").alias("most"))
    return found.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", fence.alias("fence")))).alias("fences"))


def judged(rows: DataFrame, limits: DataFrame, spread: list[str]) -> DataFrame:
    """rows (lang, source, q, ...) plus base_failed and kept; limits: one row per language and source."""
    failed = base_failed(F.col("q.n_words"), F.col("q.n_repeat_words"))
    joined = lookup(rows, limits, ["lang", "source"], spread)
    inside = F.lit(True)
    for (m, _, _), value in zip(MEASURES, rates(F.col("q")), strict=True):
        fence = F.col("fences")[m]
        inside = inside & F.coalesce(value.between(fence["least"], fence["most"]), F.lit(True))
    return joined.select(*rows.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def quality(docs: DataFrame, parent: int = PARENT_WEIGHS) -> DataFrame:
    """docs (text, lang, source and any other columns) plus q (the counts), base_failed and kept.

    A null text has no words and fails; null languages and sources are groups of their own; repeated rows are measured and
    counted one by one; an empty table gives an empty result; columns that already have the new names, or are named fences, are
    replaced. Texts are read and measured once and kept in the shared folder with their counts, from which the sketches read
    only the counts.
    """
    docs = docs.drop("q", "base_failed", "kept", "fences")
    rows = stored(measured(docs), "measured")
    limits = cut(thresholds(sketch(rows), parent))
    return judged(rows, limits, ["text"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # Without the texts the measured rows are narrow enough to keep, so that each text is read once.
    rows = cut(measured(docs).drop("text"))
    found = judged(rows, cut(thresholds(sketch(rows))), ["doc_id"])
    return found.select("doc_id", *[F.col(f"q.{c}") for c in COUNTS if c != "n_lines"], "base_failed", "kept")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
t AS (SELECT rid, i, CASE WHEN lead(i, 2) OVER p IS NOT NULL THEN word || chr(10) || lead(word) OVER p || chr(10) || lead(word, 2) OVER p END AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS again FROM t),
c AS (SELECT rid, again OR coalesce(lag(again) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS covered FROM r WINDOW p AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)
),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    {'measure': 'symbol_share', 'value': n_symbols * 1000000 // greatest(word_chars, 1), 'spread': 5000, 'both': false},
    {'measure': 'dup_line_share', 'value': n_dup_lines * 1000000 // greatest(n_lines, 1), 'spread': 100000, 'both': false},
    {'measure': 'repeat_share', 'value': n_repeat_words * 1000000 // greatest(n_words, 1), 'spread': 100000, 'both': false},
    {'measure': 'mean_word', 'value': word_chars * 1000 // greatest(n_words, 1), 'spread': 400, 'both': true}] AS ms
  FROM m
),
v AS (SELECT rid, lang, source, base_failed, x.measure AS measure, x.value AS value, x.spread AS spread, x.both AS both_sides FROM (SELECT *, unnest(ms) AS x FROM b)),
k AS (SELECT lang, source, measure, spread, both_sides, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS low FROM v WHERE NOT base_failed),
g AS (SELECT lang, source, measure, spread, both_sides, low, count(*) AS n FROM k GROUP BY ALL),
gl AS (SELECT lang, measure, low, sum(n) AS n FROM g GROUP BY ALL),
ga AS (SELECT measure, low, sum(n) AS n FROM g GROUP BY ALL),
cells AS (
  SELECT h.lang, h.source, h.measure, h.spread, h.both_sides, ga.low, coalesce(g.n, 0) AS own, coalesce(gl.n, 0) AS of_lang, ga.n AS of_all
  FROM (SELECT DISTINCT lang, source, measure, spread, both_sides FROM g) h JOIN ga ON ga.measure = h.measure
  LEFT JOIN g ON g.lang IS NOT DISTINCT FROM h.lang AND g.source IS NOT DISTINCT FROM h.source AND g.measure = h.measure AND g.low = ga.low
  LEFT JOIN gl ON gl.lang IS NOT DISTINCT FROM h.lang AND gl.measure = h.measure AND gl.low = ga.low
),
s AS (
  SELECT *, (sum(own) OVER c)::DOUBLE AS own_upto, (sum(of_lang) OVER c)::DOUBLE AS lang_upto, (sum(of_all) OVER c)::DOUBLE AS all_upto,
    (sum(own) OVER p)::DOUBLE AS own_sum, (sum(of_lang) OVER p)::DOUBLE AS lang_sum, (sum(of_all) OVER p)::DOUBLE AS all_sum
  FROM cells WINDOW c AS (PARTITION BY lang, source, measure ORDER BY low), p AS (PARTITION BY lang, source, measure)
),
u AS (SELECT *, own_upto + 200::DOUBLE * (lang_upto + 200::DOUBLE * all_upto / all_sum) / (lang_sum + 200::DOUBLE) AS upto, own_sum + 200::DOUBLE AS total FROM s),
q AS (SELECT lang, source, measure, spread, both_sides, min(low) FILTER (WHERE 4 * upto >= total) AS q1, min(low) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
f AS (SELECT *, CASE WHEN both_sides THEN q1 - 4 * greatest(q3 - q1, spread) ELSE -1 END AS least, q3 + 4 * greatest(q3 - q1, spread) AS most FROM q),
j AS (
  SELECT v.rid, bool_and(coalesce(value BETWEEN f.least AND f.most, true)) AS inside FROM v
  LEFT JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.measure = v.measure
  GROUP BY v.rid
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM b JOIN j USING (rid)
"""
