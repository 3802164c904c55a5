"""Secret scans with multipart credential linking, in DataFrame functions only.

Three strong patterns are always reported. Weaker parts of credentials (named identifiers, short or unusually named secrets,
key-like strings, endpoints) mean little alone: they are reported only where complementary parts, a secret with an identifier
or an endpoint, lie within one scope: at most SCOPE code points between the end of one and the start of the other. That is an
interval join: every part lies in the stretches of SCOPE code points that it covers, every weak part looks into those that its
scope reaches, and parts that meet there are compared by their distance. It is a semi-join, so no pairs of parts are rows, and
a stretch holds no more parts than fit into it.

Positions are those of code points: the text is split at the matches, and the lengths of what lies between are added up. All
work on one text grows with its length and the number of its spans: running sums and maxima are taken in blocks of BLOCK, overlaps
are found by binary search, and a text is masked by stretches of STRETCH code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCOPE = 400
MASK = "[SECRET]"
#: Spans whose running sums are taken at a time, and code points that are masked at a time.
BLOCK, STRETCH = 64, 2048

#: The patterns of strong spans. Runs of a class are maximal, so their least lengths can be part of the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Parts that count only together.
WEAK_ID = r"""(?i:access_?key_?id|key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
WEAK_SECRET = r"""(?i:password|passwd|secret|token|api_?key|passphrase|pwd|private_?key|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})"""
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"""(?:https?|ftp|s3|amqp|mongodb|postgres(?:ql)?|mysql|redis)://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9.])"""
#: A text without these has no secret part but hex runs and key-like strings.
NAMED = r"""(?i:password|passwd|secret|token|api_?key|passphrase|pwd|private_?key|credential)["']?\x20*[:=]"""

#: Order of kinds among spans of one start.
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
SPAN = "struct<start: int, kind: int, end: int>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: what a lambda's body names from outside is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_blocks(values: Column) -> Column:
    """An array as arrays of BLOCK of its values."""
    n = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))


def running(values: Column, add, nothing: Column) -> Column:
    """For each value (a number) the sum, or whatever add says, of those before it: within blocks, and over blocks."""
    start = F.struct(nothing.alias("at"), F.array().cast("array<int>").alias("before"))
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before"))
    each = lambda array: F.aggregate(array, start, step)
    blocks = lambda v: F.transform(_in_blocks(v), each)
    joined = lambda b: F.flatten(F.zip_with(b, each(F.transform(b, lambda x: x["at"]))["before"], lambda x, base: F.transform(x["before"], lambda y: add(base, y))))
    return _let(values, lambda v: _let(blocks(v), joined))


def located(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in order; least: characters that the pattern's first group must have."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length) if least else F.array().cast("array<int>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def spans(x: Column) -> Column:
        sized = F.transform(x["matches"], lambda size, i: F.struct(F.get(x["gaps"], i).alias("gap"), size.alias("size"), (F.get(x["values"], i) if least else F.lit(0)).alias("value")))
        at = running(F.zip_with(x["matches"], F.slice(x["gaps"], 1, F.size(x["matches"])), lambda m, g: m + g), lambda a, n: a + n, F.lit(0))
        found = F.zip_with(sized, at, lambda s, n: F.struct((n + s["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (n + s["gap"] + s["size"]).alias("end"), s["value"].alias("value")))
        return F.transform(F.filter(found, lambda s: s["value"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return _let(F.struct(matches.alias("matches"), values.alias("values"), gaps.alias("gaps")), lambda x: F.when(F.size(x["matches"]) > 0, spans(x)).otherwise(F.expr(NONE)))


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.expr(NONE))


def before(spans: Column, at: Column) -> Column:
    """How many of the spans, which come in order, begin before a place: by binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        middle = F.floor((low + high) / 2).cast("int")
        less = F.get(spans, middle)["start"] < at
        return F.when(low < high, F.when(less, F.struct((middle + 1).alias("low"), high.alias("high"))).otherwise(F.struct(low.alias("low"), middle.alias("high")))).otherwise(acc)

    return F.aggregate(steps, start, step, lambda acc: acc["low"])


def _clear_of(spans: Column, others: list[Column]) -> Column:
    """The spans that meet none of the others; each array of others comes in order and without overlaps."""
    clear = lambda other: lambda s: F.coalesce(F.get(other, before(other, s["end"]) - 1)["end"] <= s["start"], F.lit(True))
    for other in others:
        spans = F.filter(spans, clear(other))
    return spans


def scanned(docs: DataFrame) -> DataFrame:
    """docs plus base (strong spans, by start and kind) and weak (parts that overlap none of them).

    Identifiers and endpoints are looked for where the text holds any secret part: elsewhere they have no complement. A null text
    is empty; columns of the new names, and those of the steps between, must not be there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_named", text.rlike(NAMED)).withColumn("_key", text.contains("AKIA")).withColumn("_hex", text.rlike(HEX)).withColumn("_blob", text.rlike(BLOB))
    strong = {"_assign": _if(F.col("_named"), located(text, ASSIGN, "assign", 8)), "_access": _if(F.col("_key"), located(text, ACCESS, "access")), "_hexes": _if(F.col("_hex"), located(text, HEX, "hex"))}
    rows = rows.withColumns(strong).withColumn("base", F.array_sort(F.concat(*strong)))
    secret = F.col("_named") | F.col("_hex") | F.col("_key") | F.col("_blob")
    weak = F.concat(_if(F.col("_named"), located(text, WEAK_SECRET, "key")), _if(F.col("_blob"), located(text, BLOB, "key")), _if(secret, located(text, WEAK_ID, "id")), _if(secret, located(text, ENDPOINT, "endpoint")))
    return rows.withColumn("weak", weak).withColumn("weak", _clear_of(F.col("weak"), [F.col(c) for c in strong])).drop("_named", "_key", "_hex", "_blob", *strong)


def linked(rows: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """rows (key, base, weak) -> key, found: the weak spans that have a complementary part, weak or strong, within the scope.

    Spans that overlap are no distance apart. Rows without weak spans, and those whose spans have no complement, are left out.
    """
    secret = F.col("kind").isin(*[KINDS.index(k) for k in ("assign", "hex", "key")])

    def every(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    parts = rows.select(*key, F.explode(F.concat("base", "weak")).alias("p")).select(*key, "p.*")
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in key], secret.alias("_secret"), F.col("start").alias("_start"), F.col("end").alias("_end"), every(F.col("start"), F.col("end")).alias("_stretch"))
    asked = rows.select(*key, F.explode("weak").alias("span")).select(*key, "span", "span.*")
    asked = asked.select(*key, "span", "start", "end", secret.alias("secret"), every(F.col("start") - scope, F.col("end") + scope).alias("stretch"))
    near = (F.col("_start") - F.col("end") <= scope) & (F.col("start") - F.col("_end") <= scope)
    same = [F.col(c) == F.col(f"_{c}") for c in key] + [F.col("stretch") == F.col("_stretch"), F.col("secret") != F.col("_secret")]
    met = asked.join(parts, [*same, near], "left_semi")
    return met.groupBy(*key).agg(F.collect_set("span").alias("found"))


def all_spans(base: Column, found: Column) -> Column:
    return F.array_sort(F.concat(base, F.coalesce(found, F.expr(NONE))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def suspect(text: Column) -> Column:
    """Whether a text holds anything that a finding needs."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(NAMED) | text.contains("AKIA") | text.rlike(HEX) | (text.rlike(BLOB) & (text.rlike(WEAK_ID) | text.rlike(ENDPOINT)))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs (doc_id, text and any other columns) plus spans: start, kind (a place in KINDS) and end (exclusive) of every finding.

    A null text is empty; null ids and repeated rows are rows like any other; an empty table gives an empty result. Few texts
    are suspect: only those are kept in the shared folder, numbered and, if they have weak parts, joined; all others pass.
    Columns that are named like the new one, or like one of the steps between, are replaced.
    """
    docs = docs.drop("spans", "base", "weak", "found", "_row", "_named", "_key", "_hex", "_blob", "_assign", "_access", "_hexes")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clear = docs.where(~suspect(F.col("text"))).select(*columns, F.expr(NONE).alias("spans"))
    rows = cut(scanned(docs.where(suspect(F.col("text"))))).withColumn("_row", F.monotonically_increasing_id())
    weak = rows.where(F.size("weak") > 0)
    joined = weak.join(linked(weak, ["_row"], scope), "_row", "left").select(*columns, all_spans(F.col("base"), F.col("found")).alias("spans"))
    return clear.unionByName(rows.where(F.size("weak") == 0).select(*columns, F.col("base").alias("spans"))).unionByName(joined)


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """text with each run of spans replaced by mask; spans that overlap are one run. A null text, or one without spans, stays as it is.

    Spans come in order. A stretch of the text knows the runs that begin in it, and how far the one before reaches into it.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def runs(s: Column) -> Column:
        """Runs begin with spans that nothing before reaches into, and end where all before the next one has ended."""
        reached = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        seen = F.zip_with(s, reached, lambda x, r: F.struct(x["start"].alias("start"), r.alias("reached")))
        fresh = F.filter(seen, lambda x: x["start"] >= x["reached"])
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return _let(F.struct(fresh.alias("fresh"), last.alias("last")), lambda x: F.transform(x["fresh"], lambda f, i: F.struct(f["start"].alias("start"), F.coalesce(F.get(x["fresh"], i + 1)["reached"], x["last"]).alias("end"))))

    def stretch(held: Column, part: Column, i: Column) -> Column:
        first, size = i * STRETCH, F.length(part)
        low, high = before(held, first), before(held, first + size)
        # What the stretch begins with may belong to a run before it.
        begin = F.least(F.greatest(F.coalesce(F.get(held, low - 1)["end"], F.lit(0)) - first, F.lit(0)), size)

        def joined(inside: Column) -> Column:
            at = F.concat(F.array(begin), F.transform(inside, lambda s: F.least(s["end"] - first, size)))
            to = F.concat(F.transform(inside, lambda s: s["start"] - first), F.array(size))
            return F.array_join(F.zip_with(at, to, lambda a, z: F.substring(part, a + 1, z - a)), mask)

        return _let(F.slice(held, low + 1, high - low), joined)

    whole = _let(runs(spans), lambda held: F.array_join(F.transform(parts, lambda part, i: stretch(held, part, i)), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without the texts what is found is narrow enough to keep, so that each text is read once.
    rows = cut(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")).withColumn("_row", F.monotonically_increasing_id())
    weak = rows.where(F.size("weak") > 0)
    joined = weak.join(linked(weak, ["_row"]), "_row", "left").select("doc_id", "base", all_spans(F.col("base"), F.col("found")).alias("spans"))
    both = rows.where(F.size("weak") == 0).select("doc_id", "base", F.col("base").alias("spans")).unionByName(joined)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return both.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
