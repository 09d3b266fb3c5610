"""Benchmark decontamination by spaced seeds.

Each fixed mask reads some of the tokens of a window and ignores the others, so a substituted token
leaves the hashes of windows that ignore it unchanged.  Hashes of test items and of texts are
joined, and around each hit the two are aligned on its diagonal: the stretch with the best balance
of equal and different tokens decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, words

#: Masks over ten to twelve tokens; 1 reads a token, 0 ignores it.
MASKS = ("1101100111", "1110010111", "110110010111")
#: Items with fewer tokens than a mask are sought whole, from this length on.
SHORTEST = 4
#: Characters of test items that one broadcast holds; a larger benchmark takes several passes.
PASS_CHARS = 32_000_000
_BITS = 22
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens(WordHashes):
    """Hash of a word without signs around it; 0 for a word of signs only."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_SIGNS)
        value = super().__missing__(word) if bare == word else (self[bare] if bare else 0)
        self[word] = value
        return value

    def text(self, text: str | None) -> np.ndarray:
        out = self.of(words(text))
        return out[out != 0]


def masked(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window under a mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, read in enumerate(mask):
        if read == "1":
            out = out * _MULTIPLY + tokens[k:k + n]
    return (out ^ (out >> np.uint64(31))) * _MULTIPLY


class Index:
    """Test items and their masked windows, sorted by hash, with a bit table that rules most windows out."""

    def __init__(self, items: list[tuple[int, str]]):
        seen = Tokens()
        self.ids = [i for i, _ in items]
        self.tokens = [seen.text(t) for _, t in items]
        lengths = {len(t) for t in self.tokens}
        self.masks = list(MASKS) + ["1" * n for n in sorted(lengths) if SHORTEST <= n < len(MASKS[0])]
        hashes, item, at = [], [], []
        for k, tokens in enumerate(self.tokens):
            for mask in self.masks:
                if mask in MASKS or len(mask) == len(tokens):
                    found = masked(tokens, mask)
                    hashes.append(found)
                    item.append(np.full(len(found), k))
                    at.append(np.arange(len(found)))
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *item])[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *at])[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - _BITS)] = True

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of all equal windows; the diagonal is position in the text less that in the item."""
        out = []
        for mask in self.masks:
            found = masked(tokens, mask)
            where = np.flatnonzero(self.bits[found >> np.uint64(64 - _BITS)])
            low, high = (np.searchsorted(self.hashes, found[where], side) for side in ("left", "right"))
            times = high - low
            k = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append(np.stack([self.item[k], np.repeat(where, times) - self.at[k]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def overlap(self, tokens: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int]:
        """(equal tokens, start, end in the text) of the stretch with the best sum of +1 and, for a difference, -2."""
        own = self.tokens[item]
        low, high = max(0, -diagonal), min(len(own), len(tokens) - diagonal)
        same = own[low:high] == tokens[low + diagonal:high + diagonal]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        gain = total - np.minimum.accumulate(total)
        end = int(gain.argmax())
        start = int(np.flatnonzero(total[:end + 1] == total[:end + 1].min())[-1])
        return int(same[start:end].sum()), start + low + diagonal, end + low + diagonal


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // PASS_CHARS)
    for k in range(n):
        yield Index([(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect()])


def _found(index: Index, texts: list[str | None], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, equal tokens, start, end): the best stretch of each text with each item."""
    seen = _worker
    all_tokens = [seen.text(t) for t in texts]
    starts = np.cumsum([0] + [len(t) for t in all_tokens])
    hits = index.hits(np.concatenate([np.zeros(0, np.uint64), *all_tokens]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, diagonal in hits.tolist():
        # the diagonal runs over all texts of the batch; the hit lies in each text that the item then overlaps
        first = int(np.searchsorted(starts, max(diagonal, 0), "right")) - 1
        last = int(np.searchsorted(starts, min(diagonal + len(index.tokens[item]), starts[-1]), "left"))
        for row in range(first, min(last, len(texts))):
            equal, start, end = index.overlap(all_tokens[row], item, diagonal - int(starts[row]))
            if equal >= min(least, len(index.tokens[item])) and equal > best.get((row, item), (0,))[0]:
                best[row, item] = equal, start, end
    for (row, item), value in sorted(best.items()):
        yield row, item, *value


_worker = Tokens()


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, item_id, n_equal, start, end, n_tokens): texts and test items that share a stretch.

    A stretch counts with at least ``least`` equal tokens, or all tokens of a shorter item; start and
    end count tokens of the text, n_tokens those of the item.  Null and empty texts and items match
    nothing; an item of fewer than four tokens is not sought.  Equal rows give equal results.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, n_equal int, start int, end int, n_tokens int"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in _passes(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for k in range(0, len(batch), 500):
                    ids = batch.column("doc_id").slice(k, 500).to_pylist()
                    rows = [(ids[row], index.ids[item], equal, start, end, len(index.tokens[item])) for row, item, equal, start, end
                            in _found(index, batch.column("text").slice(k, 500).to_pylist(), least)]
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)],
                                                         names=["doc_id", "item_id", "n_equal", "start", "end", "n_tokens"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 10) -> DataFrame:
    """The documents (all columns) that share no stretch with any test item."""
    for index in _passes(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), 500):
                    part = batch.slice(k, 500)
                    bad = {row for row, *_ in _found(shared.value, part.column("text").to_pylist(), least)}
                    yield part.filter(pa.array([row not in bad for row in range(len(part))], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
