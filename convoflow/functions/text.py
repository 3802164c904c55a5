"""Text expressions: stripping, lines, sentences, legality, file names, templates."""

from __future__ import annotations

import string

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What str.strip() removes, and where str.splitlines() splits.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: What ends a sentence, and characters that no legal text holds (control characters but tab, line feed and return).
SENTENCE_END = r"(?<=[。！？?!])"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
REPLACEMENT = "\ufffd"
ALL = ("ALL", "全部")


def strip(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def lines(text: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAK, -1), strip), lambda x: x != "")


def sentences(line: Column) -> Column:
    """A line's sentences, each with what ends it."""
    return F.filter(F.split(line, SENTENCE_END, -1), lambda x: x != "")


def legal(text: Column, min_chars: int | None = None, max_chars: int | None = None, deny: list[str] | None = None) -> Column:
    """Stripped length in bounds, no replacement or control characters, no denied pattern.

    Named groups may be written as in Python; patterns that the JVM, which runs them, cannot compile are left out.
    """
    size = F.length(strip(text))
    found = (size >= max(1, min_chars or 1)) & ~F.contains(text, F.lit(REPLACEMENT)) & ~text.rlike(CONTROL)
    if max_chars is not None:
        found = found & (size <= max_chars)
    for pattern in deny or []:
        pattern = pattern.replace("(?P<", "(?<")
        try:
            SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException:
            continue
        found = found & ~text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def safe_name(role: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(role, r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    return F.when(name == "", F.lit("EMPTY")).otherwise(name)


def pair_file_name(first: Column, second: Column) -> Column:
    return F.concat(F.lit("pair_"), safe_name(strip(first)), F.lit("__to__"), safe_name(strip(second)), F.lit(".jsonl"))


def template(text: str, fields: dict[str, Column]) -> Column | None:
    """A format string over columns as one concatenation; None if it names anything else."""
    parts: list[Column] = []
    try:
        for literal, field, spec, conversion in string.Formatter().parse(text):
            if literal:
                parts.append(F.lit(literal))
            if field is not None:
                if field not in fields or spec or conversion:
                    return None
                parts.append(fields[field])
    except ValueError:
        return None
    return F.concat(*parts) if parts else F.lit("")


def literal_or_file(value: str | None) -> str | None:
    """A text, or what the file holds that an @ stands before."""
    if value and value.startswith("@"):
        with open(value[1:], encoding="utf-8") as found:
            return found.read()
    return value
