"""The steps from the command line, each a Spark job on files:

    python -m convoflow validate lines.jsonl --errors out/errors --copy out/valid
    python -m convoflow pairs lines.jsonl --pair A,B --strict --out out/pairs
    python -m convoflow chat out/pairs --out out/chat --mode stitch --max-turns 4
    python -m convoflow stats lines.jsonl --out out/stats
    python -m convoflow sort lines.jsonl --out out/sorted
    python -m convoflow filter lines.jsonl --chunks 1,2 --out out/some
    python -m convoflow segment texts/ --out out/chunks --tokenizer tokenizer.json

Inputs are files, folders and patterns; every file of utterances is a document of its own. Run it with spark-submit, or where
Spark is configured by its defaults.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoflow.config import Settings
from convoflow.functions.text import literal_or_file
from convoflow.operators import chat, cuts, pairs, segment, stats, validate
from convoflow.sources import jsonl, sinks

#: What tells the documents of utterance files apart.
FILE = ["file"]


def _lines(spark: SparkSession, inputs: list[str]) -> DataFrame:
    found = jsonl.discover(spark, inputs)
    if not found:
        raise SystemExit(f"no input at {', '.join(inputs)}")
    return jsonl.json_lines(spark, found)


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _lines(spark, a.inputs)
    found = validate.errors(rows, FILE)
    if a.errors:
        sinks.write_json_lines(found, a.errors, "overwrite", ["file", "line_no", "code"])
    counts = found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    for r in counts:
        print(f"{r['code']}\t{r['n']}")
    if not counts and a.copy:
        rows.orderBy("file", "line_no").select("value").write.mode("overwrite").text(a.copy)
    return 1 if counts else 0


def _pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    settings = {"min_confidence": a.min_confidence, "strict": a.strict, "source_chars": (1, a.max_chars), "reply_chars": (1, a.max_chars), "deny": a.deny}
    try:
        found = pairs.from_lines(_lines(spark, a.inputs), a.pair, a.validate, FILE, **settings)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 3
    if a.list:
        for r in pairs.pair_counts(found).orderBy("from_role", "to_role").collect():
            print(f"{r['from_role']}\t{r['to_role']}\t{r['n']}")
        return 0
    sinks.write_pairs(found, a.out, a.merge)
    return 0


def _chat(spark: SparkSession, a: argparse.Namespace) -> int:
    n = chat.convert_files(
        spark, a.inputs, a.out, a.mode, min_confidence=a.min_confidence, reverse=a.reverse, system_text=literal_or_file(a.system), system_template=literal_or_file(a.system_template),
        max_turns=a.max_turns, meta=a.meta, dedupe=a.dedupe,
    )
    print(n)
    return 0


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = jsonl.utterances(_lines(spark, a.inputs))
    tables = {"lengths": stats.length_summary(rows, per=FILE), "roles": stats.role_stats(rows, per=FILE), "transitions": stats.transitions(rows, doc=FILE, per=FILE), "chunks": stats.chunk_stats(rows, FILE)}
    for name, found in tables.items():
        sinks.write_json_lines(found, f"{a.out}/{name}", "overwrite")
    print(json.dumps(stats.length_summary(rows).first().asDict()))
    return 0


def _sort(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.write_copy(jsonl.utterances(_lines(spark, a.inputs)), a.out, mode="overwrite")
    return 0


def _filter(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.write_copy(jsonl.utterances(_lines(spark, a.inputs)), a.out, [int(c) for c in a.chunks.split(",")], "overwrite")
    return 0


def _segment(spark: SparkSession, a: argparse.Namespace) -> int:
    tokens = segment.token_counter(a.tokenizer) if a.tokenizer else None
    settings = Settings(max_tokens=a.max_tokens, cover_tokens=a.cover_tokens)
    found = cuts.segment_rows(jsonl.documents(spark, a.inputs), tokens, settings.max_tokens, settings.cover_tokens)
    sinks.write_json_lines(found, a.out, "overwrite", ["doc_id", "chunk_id"])
    return 0


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="convoflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, run, out: bool = True) -> argparse.ArgumentParser:
        found = steps.add_parser(name)
        found.set_defaults(run=run)
        found.add_argument("inputs", nargs="+")
        if out:
            found.add_argument("--out", required=True)
        return found

    one = step("validate", _validate, out=False)
    one.add_argument("--errors")
    one.add_argument("--copy")
    one = step("pairs", _pairs, out=False)
    one.add_argument("--pair", action="append", help="A,B; ALL stands for every other role; may be given again")
    one.add_argument("--min-confidence", type=float, default=0.8)
    one.add_argument("--max-chars", type=int)
    one.add_argument("--deny", action="append")
    one.add_argument("--strict", action="store_true")
    one.add_argument("--validate", action="store_true")
    to = one.add_mutually_exclusive_group(required=True)
    to.add_argument("--out", help="a folder for each direction")
    to.add_argument("--merge", help="all samples together")
    to.add_argument("--list", action="store_true", help="only count the directions")
    one = step("chat", _chat)
    one.add_argument("--mode", choices=["pair", "stitch"], default="pair")
    one.add_argument("--min-confidence", type=float)
    one.add_argument("--max-turns", type=int, default=1)
    one.add_argument("--system", help="the system message, or @ and a file")
    one.add_argument("--system-template", help="the same, with fields such as {from_role}")
    for flag in ("--reverse", "--meta", "--dedupe"):
        one.add_argument(flag, action="store_true")
    step("stats", _stats)
    step("sort", _sort)
    step("filter", _filter).add_argument("--chunks", required=True, help="chunk ids, with commas between them")
    one = step("segment", _segment)
    one.add_argument("--tokenizer", help="a file of the tokenizers library; characters are counted without one")
    one.add_argument("--max-tokens", type=int, default=Settings.max_tokens)
    one.add_argument("--cover-tokens", type=int, default=Settings.cover_tokens)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one step; returns what the process should exit with: 0, 1 for lines that break rules, 3 for what stops a step."""
    found = arguments().parse_args(argv)
    return found.run(spark or SparkSession.builder.appName("convoflow").getOrCreate(), found)


if __name__ == "__main__":
    sys.exit(main())
