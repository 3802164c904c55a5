"""Documents into token-bounded, overlapping chunks.

The fold over a document's lines depends on their order and runs within the document, one Arrow batch of documents at a time,
without a shuffle. Splitting and cleaning is also there as expressions, for use by themselves.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoflow.functions.text import SENTENCE_END, lines, sentences
from convoflow.shared import small_batches, text_runs, tidy

Tokens = Callable[[str], int]


def clean_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: stripped lines that are not blank."""
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def split_sentences(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, sentence."""
    return rows.select("doc_id", "line_no", F.posexplode(sentences(F.col("line"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


_ENDS = re.compile(SENTENCE_END)


#: Pieces that a worker remembers before it starts anew, and the characters of the longest that it keeps.
KEPT_PIECES, KEPT_CHARS = 400_000, 64
#: Where two white characters meet, and where a text may always be parted.
_ODD, _PARTED = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?= \S)")


class _Sizes:
    """Token counts under a file of the tokenizers library.

    A byte-level file without a normalizer always begins a unit at a single space between two characters that are not white, and
    merges never cross units. So a text's count is the sum of those of its pieces, and each distinct piece is handed to the library
    once. Texts with an added token, which is found before units are, and all texts of other files are one piece.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as found:
            told = json.load(found)
        units, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = all(told.get(k) is None for k in ("normalizer", "truncation", "padding")) and (told.get("post_processor") or units).get("type") == "ByteLevel"
        byte_level = units.get("type") == "ByteLevel" and units.get("use_regex", True) and not units.get("add_prefix_space", True)
        self.parts = bool(plain and byte_level and model.get("type") == "BPE" and not model.get("dropout"))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def parted(self, text: str) -> bool:
        return self.parts and not (self.added and self.added.search(text))

    @staticmethod
    def pieces(text: str) -> list[str]:
        if text[:1].isspace() or text[-1:].isspace() or _ODD.search(text):
            return _PARTED.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]]

    def counted(self, split: list[list[str]]) -> list[list[int]]:
        """The counts of each text's pieces."""
        wanted = set().union(*split)
        missing = list(wanted.difference(self.known))
        if len(self.known) + len(missing) > KEPT_PIECES:  # frequent pieces are among those wanted now
            self.known = {p: self.known[p] for p in wanted.intersection(self.known)}
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            self.known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        out = [[self.known[p] for p in pieces] for pieces in split]
        for piece in missing:
            if len(piece) > KEPT_CHARS:
                del self.known[piece]
        return out

    def many(self, texts: list[str]) -> list[int]:
        return [sum(sizes) for sizes in self.counted([self.pieces(t) if self.parted(t) else [t] for t in texts])]


@functools.lru_cache(maxsize=4)
def _sizes_by(path: str) -> _Sizes:
    return _Sizes(path)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, where the package that lists them is installed."""
    from public_tokenizers import path

    return str(path(name))


class Counter:
    """Counts tokens by a file of the tokenizers library, which each worker loads once: a text, or many at a time."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[int]:
        return _sizes_by(self.path).many(texts)

    def packed(self, parts: list[str], limit: int) -> list[str]:
        """What `_packed` makes. The open text is not counted anew: only its last piece can change by what is joined to it."""
        sizes = _sizes_by(self.path)
        if not sizes.parted("".join(parts)):
            return _joined(parts, self, limit)
        out: list[list[str]] = []
        closed, last = 0, ""
        for part in parts:
            pieces = sizes.pieces(last + part)
            counts = sizes.counted([pieces])[0]
            if out and closed + sum(counts) <= limit:
                out[-1].append(part)
            else:
                out.append([part])
                if last:
                    pieces = sizes.pieces(part)
                    counts = sizes.counted([pieces])[0]
                closed = 0
            closed, last = closed + sum(counts[:-1]), pieces[-1]
        return ["".join(found) for found in out]


def token_counter(path: str) -> Tokens:
    return Counter(path)


def _sizes(tokens: Tokens, texts: list[str]) -> list[int]:
    return tokens.many(texts) if isinstance(tokens, Counter) else [tokens(t) for t in texts]


def count_column(text: str, tokens: Tokens) -> F.Column:
    """The token count of a column of texts, null for null."""

    def counted(found: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for texts in text_runs(found):
            sizes = iter(_sizes(tokens, [t for t in texts if t is not None]))
            out += [None if t is None else next(sizes) for t in texts]
        return pa.array(out, pa.int64())

    return F.arrow_udf(counted, "long")(text)


def _packed(parts: list[str], tokens: Tokens, limit: int) -> list[str]:
    """Sentences of one long line, joined while the joined text stays within the limit; a longer one stands alone."""
    return tokens.packed(parts, limit) if isinstance(tokens, Counter) else _joined(parts, tokens, limit)


def _joined(parts: list[str], tokens: Tokens, limit: int) -> list[str]:
    out: list[str] = []
    for part in parts:
        if out and tokens(out[-1] + part) <= limit:
            out[-1] += part
        else:
            out.append(part)
    return out


def cut_line(line: str, tokens: Tokens, limit: int) -> list[str]:
    """A line above the limit as its sentences, joined."""
    return _packed([part for part in _ENDS.split(line) if part], tokens, limit)


def fold(found: list[str], tokens: Tokens, max_tokens: int, cover_tokens: int) -> list[str]:
    """Chunks of a document's lines.

    A full chunk is closed and the next starts with as many lines before as fit into cover_tokens, unless the next line would
    then not fit; a line that fits nowhere stands alone, and one above max_tokens is cut into sentences.
    """
    sizes = _sizes(tokens, found)
    chunks: list[str] = []
    held: list[str] = []
    used = 0
    for i, line in enumerate(found):
        size = sizes[i]
        if size > max_tokens:
            if held:
                chunks.append("\n".join(held))
            chunks += cut_line(line, tokens, max_tokens)
            held, used = [], 0
            continue
        if held and used + size + 1 > max_tokens:
            chunks.append("\n".join(held))
            start, used = i, 0
            while start > 0 and used < cover_tokens and used + sizes[start - 1] <= cover_tokens:
                start -= 1
                used += sizes[start]
            held = found[start:i]
            if used + size + 1 > max_tokens:
                held, used = [], 0
        held.append(line)
        used += size + 1
    if held:
        chunks.append("\n".join(held))
    return chunks


def segment(docs: DataFrame, tokens: Tokens = len, max_tokens: int = 1000, cover_tokens: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, chunk_id (from 0 in each document), chunk_text. tokens: counts a text's tokens; characters by default. A null text has no chunks."""

    def chunks(texts: pa.Array) -> pa.Array:
        made = []
        for run in text_runs(texts):
            # str.splitlines() and str.strip() are what `lines` says in expressions.
            found = ([s for line in (t or "").splitlines() if (s := line.strip())] for t in run)
            made.append(pa.array([fold(f, tokens, max_tokens, cover_tokens) for f in found], pa.list_(pa.string())))
        tidy()
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    small_batches(docs.sparkSession)
    made = docs.select("doc_id", F.arrow_udf(chunks, "array<string>")("text").alias("chunks"))
    return made.select("doc_id", F.posexplode("chunks").alias("chunk_id", "chunk_text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))
