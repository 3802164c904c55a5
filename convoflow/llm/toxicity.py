"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

Two strings are alike as far as they share subsequences of three characters, each the less the more it is stretched: so an
insult stays close to itself when characters are put in or left out. The kernel of a word with a few landmark words, whitened
by the landmarks' own kernel, stands for the word; a linear machine on it is fitted to labelled sentences. Their labels are
those of their documents, so sentences are bags: a sentence of a toxic document is as toxic as its worst word, and counts as
toxic only while that word stands out; words of other documents are not toxic. Each distinct sentence counts once, so copies
of a document weigh no more than one, and words with a character put in are added as virtual examples. Punctuation is left out of words, and letters that are spaced out are read as one word.

The fit uses at most TRAIN labelled documents a class and SENTENCES of their distinct sentences a class, chosen by hashes;
sentences are cut in tasks, and only they are gathered, at most SENTENCE_WORDS words each. A machine on whole sentences (the
greatest of their words' kernels, landmark by landmark) was tried as well: it found 37 of 97 held-out toxic documents of sf0.1
with 10 false alarms, this one about twice as many with one, as the other words of a sentence blur it. Scoring is a map over
all whole texts: each task scores each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_runs, tidy

#: Labelled documents of each class that the fit uses at most, and their distinct sentences of each class; longer sentences are several.
TRAIN, SENTENCES, SENTENCE_WORDS = 2_000, 60_000, 64
#: Weight of the others' words together, in that of the toxic ones.
OTHERS_WEIGH = 20
#: Standard deviations by which a word must stand out in toxic documents to mark a sentence.
STAND_OUT = 4
#: Fixed value: left out of words.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LANDMARKS, TOXIC_LANDMARKS = 60, 44
DECAY, LENGTH = np.float32(0.5), 3
#: Longer strings are read as overlapping pieces of this many bytes.
PIECE = 32
CACHE_WORDS = 1_000_000
SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")


# ---- the kernel --------------------------------------------------------------------------------------------------------


def _matrix(words: list[bytes]) -> np.ndarray:
    """Rows of bytes, padded with 0."""
    width = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _run(width: int, heights: list[int], n: int, equal) -> np.ndarray:
    """Gap-weighted shared subsequences of three, for heights[0] other strings (longest first) and n rows of `width` characters.

    heights[j]: how many of the others have a j-th character. equal(i, j): an array of heights[j] x n that is the squared decay
    where the others' j-th characters are the rows' i-th, and 0 elsewhere. one[j] and two[j] hold the weighted matches of one
    and two characters so far whose last lies among the others' first j.
    """
    total = np.zeros((heights[0] if heights else 0, n), np.float32)
    one = [np.zeros((h, n), np.float32) for h in heights]
    two = [np.zeros((h, n), np.float32) for h in heights]
    run_one, run_two, scratch = (np.empty_like(total) for _ in range(3))
    for i in range(width):
        run_one[:] = 0
        run_two[:] = 0
        last_one = last_two = None
        for j, h in enumerate(heights):
            e, first, second, tmp = equal(i, j), run_one[:h], run_two[:h], scratch[:h]
            second *= DECAY
            first *= DECAY
            if j:
                np.multiply(e, last_two[:h], out=tmp)
                total[:h] += tmp
                np.multiply(e, last_one[:h], out=tmp)
                second += tmp
            first += e
            # What later columns see of this row's past, before this row is added.
            last_one, one[j] = one[j], one[j] * DECAY
            last_two, two[j] = two[j], two[j] * DECAY
            one[j] += first
            two[j] += second
    return total


def own_kernel(words: list[bytes]) -> np.ndarray:
    rows = np.ascontiguousarray(_matrix(words).T)
    squared = DECAY * DECAY

    def equal(i: int, j: int) -> np.ndarray:
        return (((rows[i] == rows[j]) & (rows[i] > 0)) * squared)[None]

    return _run(len(rows), [1] * len(rows), rows.shape[1], equal)[0]


class Kernel:
    """Normalised kernels with fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.order = np.array(sorted(range(len(landmarks)), key=lambda i: (-len(landmarks[i]), i)))
        self.landmarks = [landmarks[i] for i in self.order]
        marks = _matrix(self.landmarks)
        self.heights = [int((marks[:, j] > 0).sum()) for j in range(marks.shape[1])]
        self.agree = []
        for j, h in enumerate(self.heights):
            table_ = np.zeros((h, 256), np.float32)
            table_[np.arange(h), marks[:h, j]] = DECAY * DECAY
            self.agree.append(table_)
        self.own = np.sqrt(np.maximum(own_kernel(self.landmarks), 1e-12))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """words x landmarks. Strings of like length are taken together."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = sorted((i for i in range(len(words)) if len(words[i]) >= LENGTH), key=lambda i: len(words[i]))
        for k in range(0, len(order), 1024):
            part = order[k : k + 1024]
            held = [words[i] for i in part]
            rows = np.ascontiguousarray(_matrix(held).T).astype(np.intp)
            got = _run(len(rows), self.heights, len(held), lambda i, j, rows=rows: np.take(self.agree[j], rows[i], axis=1))
            got /= np.sqrt(np.maximum(own_kernel(held), 1e-12)) * self.own[:, None]
            out[np.array(part)[:, None], self.order] = got.T
        return out


# ---- texts -------------------------------------------------------------------------------------------------------------


def pieces_of(word: bytes) -> list[bytes]:
    """What the kernel reads of a word: its start is marked, as what begins a word says more than the same inside one."""
    word = b"^" + word
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def units(text: str) -> list[bytes]:
    """The words of a text in lower case and without punctuation, and every run of three or more single characters as one."""
    found = text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()
    single = [i for i, w in enumerate(found) if len(w) == 1]
    at = 0
    joined = []
    while at < len(single):
        upto = at + 1
        while upto < len(single) and single[upto] == single[upto - 1] + 1:
            upto += 1
        if upto - at >= 3:
            joined.append(b"".join(found[single[at] : single[at] + upto - at]))
        at = upto
    return found + joined


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence of a text, all in it."""
    return [found for part in SENTENCE.split(text or "") if (found := units(part))]


# ---- the machine -------------------------------------------------------------------------------------------------------


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by Newton steps on the squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        hit = slack > 0
        c = 2 * cost * weight[hit]
        gradient = ridge * w - x[hit].T @ (c * y[hit] * slack[hit])
        step = np.linalg.solve(np.diag(ridge) + (x[hit].T * c) @ x[hit], gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Machine:
    """What a fit leaves: landmark words, a weight for the kernel with each, a bias, and a curve from a text's worst word and its
    worst three together to a probability."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slopes, self.shift = np.zeros(2), 0.0
        self._kernel: Kernel | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kernel": None}

    def margins(self, words: list[bytes]) -> np.ndarray:
        if self._kernel is None:
            self._kernel = Kernel(self.landmarks)
        parts = [(i, p) for i, w in enumerate(words) for p in pieces_of(w)]
        got = self._kernel([p for _, p in parts]) @ self.weights.astype(np.float32)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, [i for i, _ in parts], got + self.bias)
        return out

    def of_texts(self, texts: list[str | None], cache: dict[bytes, float] | None = None) -> np.ndarray:
        """Margin of each text's worst word, and the mean of its worst three different ones; a string like no landmark stands for words that are not there."""
        cache = {} if cache is None else cache
        found = [units(t) if t else [] for t in texts]
        fresh = list(set().union(*found).difference(cache))
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = list(set().union(*found))
        if fresh:
            cache.update(zip(fresh, self.margins(fresh).tolist(), strict=True))
        out = np.full((len(texts), 2), self.bias)
        for i, u in enumerate(found):
            top = sorted(map(cache.__getitem__, set(u)))[-3:]
            if top:
                out[i] = top[-1], (sum(top) + (3 - len(top)) * self.bias) / 3
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.shift, -40, 40)))


def fit(found: list[tuple[int, bool, list[bytes]]], rounds: int = 3, cost: float = 40.0) -> Machine:
    """Fits distinct labelled sentences (document, toxic, words). The curve is not fitted here."""
    docs = {d: t for d, t, _ in found}
    in_other, in_toxic = Counter(), Counter()
    words_of: dict[int, set[bytes]] = {}
    for d, _, w in found:
        words_of.setdefault(d, set()).update(w)
    for d, held in words_of.items():
        (in_toxic if docs[d] else in_other).update(held)
    bad = [set(w) for _, t, w in found if t]
    share = sum(docs.values()) / max(1, len(docs))

    def stands_out(w: bytes) -> float:
        n = in_toxic[w] + in_other[w]
        return (in_toxic[w] - n * share) / np.sqrt(n * share * (1 - share) + 1)

    able = [w for w in in_toxic | in_other if len(w) >= LENGTH]
    ranked = sorted(able, key=lambda w: (-stands_out(w), w))
    common = sorted(able, key=lambda w: (-in_other[w], w))
    marks = [*[w for w in ranked[:TOXIC_LANDMARKS] if stands_out(w) >= STAND_OUT], *common[:LANDMARKS]]
    landmarks = list(dict.fromkeys(max(pieces_of(w), key=len) for w in marks))[:LANDMARKS] or [b"none"]
    kernel = Kernel(landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    others = sorted(in_other)
    words = sorted({w for w, n in in_toxic.items() if n > 2} | set(others))
    # Virtual examples of words that stand out: a character put in, at each place.
    odd = {w: [w[:i] + bytes([97 + (7 * i + len(w)) % 26]) + w[i:] for i in range(1, len(w))] for w in words if stands_out(w) >= STAND_OUT}
    odd = {w: [v for v in made if v not in in_other] for w, made in odd.items()}
    x_odd = {w: kernel([b"^" + v for v in made]) @ whiten for w, made in odd.items() if made}
    place = {w: i for i, w in enumerate(words)}
    x = kernel([max(pieces_of(w), key=len) for w in words]) @ whiten if words else np.zeros((0, len(landmarks)))
    negative = np.array([place[w] for w in others], int)
    margin = np.array([stands_out(w) for w in words])
    marked = margin >= STAND_OUT
    weights = np.zeros(len(landmarks) + 1)
    for _ in range(rounds):
        worst = [max((place[u] for u in bag if u in place), key=margin.__getitem__, default=None) for bag in bad]
        positive = Counter(p for p in worst if p is not None and marked[p])
        if not positive or not len(negative):
            break
        clean = negative[[p not in positive for p in negative.tolist()]]
        rows = np.concatenate([list(positive), clean])
        label = np.concatenate([np.ones(len(positive)), -np.ones(len(clean))])
        heavy = np.sqrt([in_other[words[p]] for p in clean.tolist()])
        weight = np.concatenate([np.fromiter(positive.values(), float), heavy * OTHERS_WEIGH * sum(positive.values()) / max(1.0, heavy.sum())])
        made = [(x_odd[words[p]], n) for p, n in positive.items() if words[p] in x_odd]
        extra = np.concatenate([m for m, _ in made]) if made else np.zeros((0, len(landmarks)))
        label = np.concatenate([label, np.ones(len(extra))])
        weight = np.concatenate([weight, *(np.full(len(m), n / len(m)) for m, n in made)])
        weights = squared_hinge(np.vstack([x[rows], extra]), label, weight, cost)
        margin = x @ weights[:-1] + weights[-1]
    return Machine(landmarks, whiten @ weights[:-1], float(weights[-1]))


def fit_texts(texts: list[str], toxic: list[bool], prior: float) -> Machine:
    """The whole fit on texts at hand; prior: the share of toxic ones among all that are labelled."""
    y = np.array(toxic, bool)
    seen: dict[tuple, tuple[bool, int]] = {}
    for i, text in enumerate(texts):
        for s in sentences(text):
            for k in range(0, len(s), SENTENCE_WORDS):
                key = tuple(s[k : k + SENTENCE_WORDS])
                seen[key] = min(seen.get(key, (True, i)), (bool(y[i]), i))
    machine = fit([(i, t, list(w)) for w, (t, i) in seen.items()])
    machine.slopes, machine.shift = _curve(machine.of_texts(texts), y, prior)
    return machine


def _curve(score: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Slopes and shift of the logistic curve that fits the labels best, classes weighted to their true shares."""
    if not len(score) or y.all() or not y.any():
        return np.zeros(2), 0.0
    weight = np.where(y, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    x = np.hstack([score, np.ones((len(score), 1))])
    sign = np.where(y, -1.0, 1.0)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, sign * (x @ w))).sum() + 5e-4 * w @ w)

    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:2], float(w[2])


def _sentences_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, words of every sentence, longer ones in parts."""
    for batch in batches:
        done = 0
        for texts in text_runs(batch.column(2)):
            for i, text in enumerate(texts, done):
                held = [s[k : k + SENTENCE_WORDS] for s in sentences(text) for k in range(0, len(s), SENTENCE_WORDS)]
                held = [[p for w in s for p in ([w] if len(w) <= PIECE else pieces_of(w))] for s in held]
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), pa.array(held, pa.list_(pa.binary()))], ["doc_id", "toxic", "words"])
            done += len(texts)
        tidy()


def _margins(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_runs(batch.column(1)):
                worst = machine.of_texts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[done : done + len(texts)], pa.array(worst[:, 0]), pa.array(worst[:, 1])], ["toxic", "worst", "three"])
                done += len(texts)

    return run


def fit_on(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, most: int = TRAIN, most_sentences: int = SENTENCES) -> Machine:
    """Fits a bounded sample of docs (doc_id, text) that labels (doc_id, toxic) mark, outside the held-out fold.

    A document that is labelled twice is toxic if either says so; of rows that repeat an id the least text is used; null ids,
    null texts and other labels are not. Sentences that occur in a document of the other class as well are not toxic.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold != held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = [marked.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(most) for t in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").where("text IS NOT NULL")
    rows = cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"))
    found = rows.mapInArrow(_sentences_of, "doc_id long, toxic int, words array<binary>")
    found = cut(found.groupBy("words").agg(F.min(F.struct("toxic", "doc_id")).alias("of")).select("of.*", "words"))
    parts = [found.where(F.col("toxic") == t).orderBy(F.xxhash64("words"), "words").limit(most_sentences) for t in (0, 1)]
    held = parts[0].unionByName(parts[1]).toArrow()
    machine = fit(sorted(zip(held["doc_id"].to_pylist(), [t == 1 for t in held["toxic"].to_pylist()], held["words"].to_pylist(), strict=True)))
    margins = rows.select("toxic", "text").mapInArrow(_margins(machine), "toxic int, worst double, three double").toArrow()
    total = sum(counts.values())
    y = margins["toxic"].to_numpy() == 1
    machine.slopes, machine.shift = _curve(np.stack([margins["worst"].to_numpy(), margins["three"].to_numpy()], axis=1), y, counts.get(1, 0) / total if total else 0.5)
    return machine


def _scores(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            done = 0
            for texts in text_runs(batch.column(1)):
                worst = machine.of_texts(texts, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0)[done : done + len(texts)], pa.array(worst[:, 0]), pa.array(machine.probability(worst))], ["doc_id", "margin", "score"])
                done += len(texts)
            tidy()

    return run


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs (doc_id, text) -> doc_id, margin, score (0 to 1) for every row, from the text alone.

    A null text or one without words has the score of no likeness to any landmark; null ids and repeated rows are rows like any
    other; an empty table gives an empty result. Without labels of both classes the machine knows nothing and says so: all
    scores are equal.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(machine), "doc_id long, margin double, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
