"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two segments sums, over all three-letter subsequences they share, a decay for each
letter spanned; it is normalised and raised to a power.  Missing, doubled or inserted letters leave
most subsequences in place.  Landmarks are segments that mark toxic texts in the labelled rows; a
segment's kernel values against them, whitened, are its Nyström features.  The machine is trained on
the segments of each labelled text that come nearest to landmarks, with corrupted copies of toxic
ones added, and a text's margin is the largest one among its segments.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SPAN, DECAY, POWER, LENGTH, HEAD = 7, 0.5, 4, 24, 6
#: Segments that a task remembers with their margin before it starts afresh.
CACHE_SEGMENTS = 250_000
#: Digits read as the letters they stand in for inside words.
DIGITS = str.maketrans("0134578", "oieastb")

_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]+\w){2,}(?!\S)")
_CODES = np.full(128, 27, np.int32)
_CODES[ord("a"):ord("z") + 1] = np.arange(26)


def segments(token: str) -> list[str]:
    """A word's letters without signs, digits as letters; long runs as overlapping pieces.

    The head of a longer word is a segment too, since endings would dilute its kernel values.
    """
    if not (token.isascii() and token.isalpha()):
        token = "".join(c for c in unicodedata.normalize("NFC", token) if c.isalnum())
        if not token or token.isdigit():
            return []
        token = token.translate(DIGITS)
    if len(token) <= LENGTH:
        return [] if len(token) < 3 else [token] if len(token) <= HEAD else [token, token[:HEAD]]
    return [token[:HEAD], *(token[i:i + LENGTH] for i in range(0, len(token) - SPAN, LENGTH - SPAN))]


def tokens(text: str) -> set[str]:
    """Distinct lower-case words, and letters spelled out with spaces between as words of their own."""
    low = text.lower()
    out = set(low.split())
    out.update("".join(m.group().split()) for m in _SPELLED.finditer(low))
    return out


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a segment of n letters within the span, and their decays."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _triples(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (row per segment, all of one length) and decays."""
    n = len(batch[0])
    raw = np.frombuffer("".join(batch).encode("utf-32-le", "replace"), np.uint32).reshape(-1, n)
    codes = np.where(raw < 128, _CODES[raw & 127], 28 + (raw & 3)).astype(np.int32).T  # other letters share four codes
    at, decay = _grid(n)
    return ((codes[at[:, 0]] << 10) + (codes[at[:, 1]] << 5) + codes[at[:, 2]]).T, decay


class Landmarks:
    """Landmarks as a table: a row for each subsequence code that one of them holds, a column for each landmark."""

    def __init__(self, names: list[str]):
        parts = [_triples([z]) for z in names]
        held = [codes[0] for codes, _ in parts]
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *held]).astype(np.int64))
        self.count, self.used = len(names), np.zeros(1 << 15, bool)
        self.used[used] = True
        self.row = np.zeros(1 << 15, np.int32)
        self.row[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(names)))
        for k, (codes, decay) in enumerate(parts):
            np.add.at(self.table[:, k], self.row[codes[0]], decay)
        self.table /= np.maximum(np.sqrt((self.table ** 2).sum(0)), 1e-12)


#: Products of a segment's subsequences with the landmarks that are worked out at once, in segments times landmarks.
AT_ONCE = 32_000


def kernel(found: list[str], landmarks: list[str] | Landmarks) -> np.ndarray:
    """Kernel of every segment (rows) with every landmark, 0 to 1."""
    marks = landmarks if isinstance(landmarks, Landmarks) else Landmarks(landmarks)
    used, table, row = marks.used, marks.table, marks.row
    out = np.zeros((len(found), marks.count))
    lengths = np.array([len(s) for s in found])
    at_once = max(50, AT_ONCE // max(32, marks.count))  # many landmarks make wide rows
    for n in np.unique(lengths):
        if n < 3:
            continue
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, -(-len(rows) // at_once)):
            codes, decay = _triples([found[i] for i in part])
            hit, col = np.nonzero(used[codes])
            if not len(hit):
                continue
            own, first = np.unique(hit, return_index=True)
            dots = np.add.reduceat(table[row[codes[hit, col]]] * decay[col, None], first)
            near = dots.max(1) >= 0.25 * np.sqrt((decay ** 2).sum())  # values that can't reach 0.25 count as 0
            own, dots = own[near], dots[near]
            if len(own):
                keys, back = np.unique((np.arange(len(own))[:, None] << 15) + codes[own], return_inverse=True)
                sums = np.bincount(back.ravel(), np.broadcast_to(decay, (len(own), len(decay))).ravel())
                norms = np.sqrt(np.bincount(keys >> 15, sums ** 2))
                value = dots / norms[:, None]
                out[part[own]] = np.where(value >= 0.25, value, 0)
    return out ** POWER


#: Segments whose kernel values a task holds at once.
PART = 4096


@dataclass
class Machine:
    """Landmarks, weights of their kernel values, offset, and the sigmoid of the margin."""

    landmarks: list[str]
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def __post_init__(self):
        self.marks = Landmarks(self.landmarks)

    def margins(self, found: list[str]) -> np.ndarray:
        parts = [kernel(found[k:k + PART], self.marks) @ self.weights for k in range(0, len(found), PART)]
        return np.concatenate([np.zeros(0), *parts]) + self.offset

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def corrupted(word: str, seed: int) -> str:
    """The word with one letter doubled, dropped or inserted."""
    rng = random.Random(f"{word}:{seed}")
    at = rng.randrange(len(word))
    return word[:at] + rng.choice([word[at] * 2, rng.choice("aeinrstx") + word[at], "" if len(word) > 5 else word[at] * 2]) + word[at + 1:]


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss and a constant column, by Newton steps over its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        on = y * (x @ w) < 1
        new = np.linalg.solve(ridge + (x[on].T * cost[on]) @ x[on], (x[on].T * cost[on]) @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins with a slight ridge."""
    x, target, w = np.stack([margin, np.ones_like(margin)], 1), (y > 0).astype(float), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-3 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def stems(token: str) -> set[str]:
    """What may become a landmark: a word's segments and its beginnings of four letters and more."""
    found = segments(token)
    return set(found) | {found[0][:n] for n in range(4, HEAD) if found and len(found[0]) > n}


def distinct_stems(ranked: list[tuple[str, int]], n: int) -> list[str]:
    """The first n stems; of stems that begin alike and mark nearly the same texts, the longest stands for all."""
    chosen: dict[str, int] = {}
    for stem, count in ranked:
        shorter = [c for c in chosen if stem.startswith(c)]
        longer = [c for c in chosen if c.startswith(stem)]
        if any(count >= 0.9 * chosen[c] for c in shorter):
            for c in shorter:
                if count >= 0.9 * chosen[c]:
                    del chosen[c]
            chosen[stem] = count
        elif not shorter and len(chosen) < n and all(count >= 1.3 * chosen[c] for c in longer):
            chosen[stem] = count
    return list(chosen)


def train(labelled: DataFrame, n_landmarks: int | None = None, chance: float = 0.01, witnesses: int = 5) -> Machine | None:
    """A machine from (text, toxic); None without both classes or without a segment that marks toxic texts.

    The caller bounds the rows.  A segment is a landmark if its share among toxic texts is more than
    three times that among clean ones, with less than ``chance`` that any of all segments seems so
    by accident; how many there are follows the sample.  Frequencies and witnesses are worked out by Spark; the driver gets
    the strongest segments and a few segments of each row.
    """
    labelled = stored(labelled.where("toxic IS NOT NULL AND text IS NOT NULL").select("text", "toxic")
                      .dropDuplicates(["text"]), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                (toxic if label == 1 else clean).update({s for t in tokens(text) for s in stems(t)})
        found = list(toxic | clean)
        for k in range(0, len(found), 50_000):
            part = found[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[s] for s in part], pa.int64()),
                                              pa.array([clean[s] for s in part], pa.int64())], names=["segment", "p", "q"])

    marks = labelled.mapInArrow(count, "segment string, p long, q long").groupBy("segment").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    marks = stored(marks, "toxicity-segments")
    # Chernoff's bound on the chance of p toxic texts among p + q were the shares' ratio three
    even = 3 * n[1] / (3 * n[1] + n[0])
    share = F.col("p") / (F.col("p") + F.col("q"))
    rest = F.when(F.col("q") > 0, F.col("q") * F.log((1 - share) / (1 - even))).otherwise(0.0)
    found = (marks.where(F.col("p") * n[0] > 3 * F.col("q") * n[1]).withColumn("sure", F.col("p") * F.log(share / even) + rest)
             .where(F.col("sure") > math.log(max(1, marks.count()) / chance)).orderBy(F.col("sure").desc(), "segment").collect())
    landmarks = distinct_stems([(r["segment"], r["p"]) for r in found], n_landmarks or len(found))
    if not landmarks:
        return None

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({s for t in tokens(text) for s in segments(t)}) for text in batch.column("text").to_pylist()]
            every = sorted({s for x in own for s in x})
            best = dict(zip(every, kernel(every, landmarks).max(1).tolist() if every else [], strict=True))
            keep = [sorted(x, key=lambda s: (-best[s], s))[:witnesses] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(keep, pa.list_(pa.string()))], names=["toxic", "found"])

    rows = labelled.mapInArrow(top, "toxic int, found array<string>").collect()
    y = np.array([1.0 if r["toxic"] == 1 else -1.0 for r in rows])
    found = [r["found"] or [""] for r in rows]
    square = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh(square)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    every = sorted({s for x in found for s in x})
    place = {s: k for k, s in enumerate(every)}
    values = kernel(every, landmarks)
    features, near = values @ whiten, values.max(1)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    at = np.array([place[s] for f in found for s in f])
    # a toxic text's segment is toxic where it matches a landmark; the rest of such a text says little
    toxic, strong = y[row] > 0, near[at] > 0.6
    more = [corrupted(s, k) for s in sorted({every[i] for i in at[toxic & strong]}) for k in range(4)]
    times = Counter(every[i] for i in at[toxic & strong])
    extra = np.array([times[s] / 8 for s in sorted(times) for _ in range(4)])
    x = np.vstack([features[at], kernel(more, landmarks) @ whiten if more else features[:0]])
    label = np.concatenate([y[row], np.ones(len(more))])
    cost = np.concatenate([np.where(toxic & ~strong, 0.005, 1.0), extra])
    w = svm(x, label, 4 * cost)
    weights = whiten @ w[:-1]
    margin = features @ w[:-1] + w[-1]
    of_text = np.full(len(found), -np.inf)
    np.maximum.at(of_text, row, margin[at])
    at = np.concatenate([of_text, kernel(more, landmarks) @ weights + w[-1] if more else []])
    label = np.concatenate([y, np.ones(len(more))])
    slope, shift = sigmoid(at, label, np.concatenate([np.ones(len(y)), extra]))
    return Machine(landmarks, weights, float(w[-1]), max(slope, 1e-3), shift)


class Margins(dict):
    """Word to its margin; words not seen yet are worked out many at a time."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine = machine

    def learn(self, unknown: set[str]) -> None:
        if len(self) + len(unknown) > CACHE_SEGMENTS:
            self.clear()
        split = {t: segments(t) for t in unknown}
        found = list({s for x in split.values() for s in x})
        of = dict(zip(found, self.machine.margins(found).tolist() if found else [], strict=True))
        none = self.machine.offset
        self.update((t, max(map(of.__getitem__, x), default=none)) for t, x in split.items())

    def texts(self, found: list[str | None]) -> np.ndarray:
        own = [tokens(text) if text else set() for text in found]
        unknown = {t for t in set().union(*own) if t not in self}
        if unknown:
            if len(self) + len(unknown) > CACHE_SEGMENTS:
                unknown = set().union(*own)
            self.learn(unknown)
        return np.array([max(map(self.__getitem__, x), default=self.machine.offset) for x in own])


def score(docs: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
          out: str = "score") -> DataFrame:
    """``keep`` columns and the score (double) of every whole text.

    Null, empty and wordless texts get the score of a text in which nothing matches; without a
    machine every score is 0.  A text's score depends on nothing but the text.
    """
    names = list(keep)
    if machine is None:
        return docs.select(*names, F.lit(0.0).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(shared.value)
        for batch in batches:
            column = batch.column(text)
            for k in range(0, len(column), 500):
                value = shared.value.score(margins.texts(column.slice(k, 500).to_pylist()))
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(value)], names=names + [out])

    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(out, T.DoubleType())])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, limit: int) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled documents outside fold 0, drawn by the hash of their id.

    A document labelled more than once counts as toxic if any label says so; rows without id or
    label are left out.  The limit bounds what is broadcast to pick the texts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    drawn = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 0)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
