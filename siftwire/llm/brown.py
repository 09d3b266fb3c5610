"""Scores of a class-based bigram model whose classes come from exchange clustering, beside a unigram base.

Counts cover all training texts.  Words with a fixed share of all tokens are few at any size: their
counts travel with the tasks.  The others meet their texts' words in buckets by word hash, and
each bucket returns sums and classes by text, so that no table of all words is held anywhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, buckets, cut, dropped, in_fold, joined, slices, stored

#: A word with this share of the training tokens travels with the tasks; at most 1,000,000 words can have it (8 MB of keys, 256 MB of counters a task).
FREQUENT = 1e-6
#: Words whose counters are sent at once.
SENT = 50_000
#: A word with this share is exchanged by itself, at most 1,000; the others start from their last two bytes, in 256 kinds.
OWN, ENDINGS = 1e-3, 256
CLASSES, SWEEPS, ADD = 32, 6, 0.1
#: Rounds in which all counted words move.
ROUNDS = 2
END = 0


class Hashes(WordHashes):
    """Word to a number of 56 hashed bits and 8 of its ending."""

    def __missing__(self, word: bytes) -> int:
        value = super().__missing__(word) & ~(ENDINGS - 1) | xxhash.xxh64_intdigest(word[-2:]) % ENDINGS
        self[word] = value
        return value


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of each ending: of two bytes at their little-endian number, of one byte 65,536 further."""
    endings = [k.to_bytes(2, "little") for k in range(1 << 16)] + [bytes([k]) for k in range(256)]
    return np.fromiter(map(xxhash.xxh64_intdigest, endings), np.uint64, len(endings)) % np.uint64(ENDINGS)


def numbers(found: pa.Array) -> np.ndarray:
    """The numbers that ``Hashes`` gives, of a whole array of words without empty ones."""
    if not len(found):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1].astype(np.int64)
    data = np.frombuffer(found.buffers()[2], np.uint8)
    last, single = data[ends[1:] - 1].astype(np.int64), np.diff(ends) == 1
    ending = np.where(single, (1 << 16) + last, data[np.maximum(ends[1:] - 2, 0)] | last << 8)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(found))
    return hashes & ~np.uint64(ENDINGS - 1) | _kinds()[ending]


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct words of the texts, each token's place among these, and each text's tokens; words as ``common.words`` cuts them."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(plain, ""), pa.scalar(None, pa.string()), plain))
    distinct = found.flatten().cast(pa.binary()).dictionary_encode()
    many = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers(distinct.dictionary), distinct.indices.to_numpy(zero_copy_only=False), many


def training(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.Array]:
    """Texts of the rows to learn from, some at a time."""
    for batch in slices(batches, "text", 1000):
        keep = [not in_fold(d, folds) for d in batch.column("doc_id").to_pylist()]
        if any(keep):
            yield batch.column("text").filter(pa.array(keep))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def counts(docs: DataFrame, folds: int, n_buckets: int) -> DataFrame:
    """(bucket, keys, counts): how often each word occurs in the training texts; END once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, v = summed(np.concatenate(keys), np.concatenate(values))
            for b, (x, y) in cut([k, v.astype(np.uint32)], ((k >> np.uint64(8)) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())],
                                                 names=["bucket", "keys", "counts"])

        for texts in training(batches, folds):
            k, at, _ = tokenised(texts)
            keys.append(np.append(k, np.uint64(END)))
            values.append(np.append(np.bincount(at, minlength=len(k)), len(texts)))
            held += len(k) + 1
            if held > 3_000_000:
                k, v = summed(np.concatenate(keys), np.concatenate(values))
                keys, values, held = [k], [v], len(k)
                if held > 1_500_000:
                    yield from flush()
                    keys, values, held = [], [], 0
        if keys:
            yield from flush()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        k, v = summed(joined(group["keys"], np.uint64), joined(group["counts"], np.uint32).astype(np.int64))
        return pd.DataFrame({"bucket": [group["bucket"].iat[0]], "keys": [k.tobytes()], "counts": [v.tobytes()], "total": [int(v.sum())], "distinct": [len(k)]})

    return (docs.select("doc_id", "text").mapInArrow(run, "bucket int, keys binary, counts binary").groupBy("bucket")
            .applyInPandas(add, "bucket int, keys binary, counts binary, total long, distinct long"))


def frequent(table: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and counts of the words with at least so many occurrences, and of END."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
                keep = (v >= least) | (k == END)
                yield pa.RecordBatch.from_arrays([pa.array([k[keep].tobytes()], pa.binary()), pa.array([v[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    rows = table.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").collect()
    return summed(joined([r["keys"] for r in rows], np.uint64), joined([r["counts"] for r in rows], np.int64))


@dataclass
class Units:
    """What is clustered: END and each word of its own share, then the endings."""

    keys: np.ndarray

    def __len__(self) -> int:
        return len(self.keys) + ENDINGS

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, tokens)
        own = at < len(self.keys)
        own[own] = self.keys[at[own]] == tokens[own]
        return np.where(own, at, len(self.keys) + (tokens & np.uint64(ENDINGS - 1)).astype(np.int64))


RARE = 0xFFFFFFFF
_BLOBS = "bucket int, kind int, a binary, b binary, c binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "kind", "a", "b", "c"])


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


def coded(docs: DataFrame, folds: int, keys: np.ndarray) -> DataFrame:
    """(ids, rare): the training texts' words, END before and after each text, as places in ``keys``; words not in it follow in ``rare``."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for texts in training(batches, folds):
            k, at, many = tokenised(texts)
            place = np.minimum(np.searchsorted(often, k), len(often) - 1)
            rare = often[place] != k
            ids = np.full(len(at) + len(many) + 1, np.searchsorted(often, np.uint64(END)), np.uint32)
            ids[np.arange(len(at)) + np.repeat(np.arange(len(many)), many) + 1] = np.where(rare, RARE, place)[at]
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([k[at[rare[at]]].tobytes()], pa.binary())], names=["ids", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, "ids binary, rare binary")


def pairs(tokens: DataFrame, keys: np.ndarray, units: Units) -> np.ndarray:
    """How often each unit follows each other one in the training texts, END before and after every text."""
    n, first = len(units), len(units.keys)
    shared = tokens.sparkSession.sparkContext.broadcast(units.of(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for x, y in zip(batch.column("ids").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                ids = np.frombuffer(x, np.uint32)
                rare = ids == RARE
                unit = shared.value[np.where(rare, 0, ids)]
                unit[rare] = first + (np.frombuffer(y, np.uint64) & np.uint64(ENDINGS - 1)).astype(np.int64)
                total += np.bincount(unit[:-1] * n + unit[1:], minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in total.reshape(n, n)], pa.binary())], names=["unit", "next"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": [group["unit"].iat[0]], "next": [sum(np.frombuffer(x, np.int64) for x in group["next"]).tobytes()]})

    out = np.zeros((n, n), np.int64)
    for r in tokens.mapInArrow(run, "unit int, next binary").groupBy("unit").applyInPandas(add, "unit int, next binary").collect():
        out[r["unit"]] = np.frombuffer(r["next"], np.int64)
    return out


def contexts(tokens: DataFrame, known: DataFrame, keys: np.ndarray, classes: np.ndarray, n: int, both_sides: bool = True) -> DataFrame:
    """(bucket, keys, classes, cells, counts, table): of every word, how often each class follows and precedes it.

    ``keys`` and ``classes`` are those of the frequent words.  The class of another neighbour is
    looked up in that neighbour's bucket.  A cell is the word's place times 2 CLASSES plus the class,
    CLASSES more if it precedes; ``table`` has the bucket's share of the class bigrams, for which
    the classes that follow are enough.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((keys, classes))
    wide = 2 * CLASSES
    sides = ((0, slice(None, -1), slice(1, None)), (CLASSES, slice(1, None), slice(None, -1)))[:1 + both_sides]

    def run(batches: Iterator[pa.RecordBatch], distant: bool) -> Iterator[pa.RecordBatch]:
        often, of = shared.value
        dense = np.zeros(0 if distant else len(often) * wide, np.uint32)

        def sent(ids: list[np.ndarray], others: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            met = [[], [], []]
            near = [[], []]
            for i, raw in zip(ids, others, strict=True):
                rare, k = i == RARE, np.zeros(len(i), np.uint64)
                k[rare] = raw
                for shift, target, other in sides:
                    ti, oi, tr, away, tk = i[target], i[other], rare[target], rare[other], k[target]
                    if distant:
                        at = np.flatnonzero(away)
                        met[0].append(k[other][at])
                        met[1].append(np.where(tr[at], tk[at], often[np.where(tr[at], 0, ti[at])]))
                        met[2].append(np.full(len(at), shift, np.uint8))
                        continue
                    at = np.flatnonzero(~(tr | away))
                    np.add.at(dense, ti[at].astype(np.int64) * wide + (of[oi[at]].astype(np.int64) + shift), np.uint32(1))  # a plain 1 is many times slower
                    at = np.flatnonzero(tr & ~away)
                    near[0].append(tk[at])
                    near[1].append(of[oi[at]] + np.uint8(shift))
            if distant:
                ok, tk, shift = map(np.concatenate, met)
                out = [(b, 0, *raw) for b, raw in cut([ok, tk, shift], _bucket(ok, n), n)]
            else:
                tk, code = map(np.concatenate, near)
                out = [(b, 1, *raw, b"") for b, raw in cut([tk, code], _bucket(tk, n), n)]
            if out:
                yield _batch(out)

        ids, others, held = [], [], 0
        for batch in batches:
            for x, y in zip(batch.column("ids").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                ids.append(np.frombuffer(x, np.uint32))
                others.append(np.frombuffer(y, np.uint64))
                held += len(ids[-1])
                if held > 1_000_000:
                    yield from sent(ids, others)
                    ids, others, held = [], [], 0
        yield from sent(ids, others)
        for start in range(0, len(dense), SENT * wide):
            cell = np.flatnonzero(dense[start:start + SENT * wide]) + start
            key = often[cell // wide]
            out = [(b, 2, *raw) for b, raw in cut([key, (cell % wide).astype(np.uint8), dense[cell]], _bucket(key, n), n)]
            if out:
                yield _batch(out)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, of = joined(right["keys"], np.uint64), joined(right["classes"], np.uint8)
        target = joined(left["b"], np.uint64)
        code = of[np.searchsorted(own, joined(left["a"], np.uint64))] + joined(left["c"], np.uint8)
        out = [(k, 1, *raw, b"") for k, raw in cut([target, code], _bucket(target, n), n)]
        return pd.DataFrame(out, columns=["bucket", "kind", "a", "b", "c"])

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, of = joined(right["keys"], np.uint64), joined(right["classes"], np.uint8)
        single, many = left["kind"] == 1, left["kind"] == 2
        once, cell = (np.searchsorted(own, joined(left["a"][k], np.uint64)) * wide + joined(left["b"][k], np.uint8) for k in (single, many))
        times = joined(left["c"][many], np.uint32).astype(np.int64)
        if len(own) * wide <= 8 * (len(once) + len(cell)):  # a counter for each cell takes no more than the sort
            total = np.bincount(once, minlength=len(own) * wide)
            np.add.at(total, cell, times)
            cell = np.flatnonzero(total)
            times = total[cell]
        else:
            cell, times = summed(np.concatenate([once, cell]), np.concatenate([np.ones(len(once), np.int64), times]))
        follows = cell % wide < CLASSES
        table = np.bincount(of[cell[follows] // wide].astype(np.int64) * CLASSES + cell[follows] % wide, times[follows], CLASSES ** 2)
        return pd.DataFrame({"bucket": [right["bucket"].iat[0]], "keys": [own.tobytes()], "classes": [of.tobytes()], "cells": [cell.astype(np.uint32).tobytes()],
                             "counts": [times.astype(np.uint32).tobytes()], "table": [table.astype(np.int64).tobytes()]})

    near = tokens.mapInArrow(lambda batches: run(batches, False), _BLOBS)
    far = tokens.mapInArrow(lambda batches: run(batches, True), _BLOBS).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(meet, _BLOBS)
    return near.union(far).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(
        gather, "bucket int, keys binary, classes binary, cells binary, counts binary, table binary")


def moved(found: DataFrame, table: np.ndarray, turn: int) -> DataFrame:
    """(bucket, keys, classes): half of the words, by turns, moved to the class that makes their neighbours' classes likeliest."""
    log = np.log(table + ADD)
    gain = np.concatenate([log.T - np.log(table.sum(1) + ADD * CLASSES), log - np.log(table.sum(0) + ADD * CLASSES)])  # neighbour's class and side by own class
    empty = table.sum(0) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x, y, z, c in zip(*(batch.column(k).to_pylist() for k in ("bucket", "keys", "classes", "cells", "counts")), strict=True):
                keys, of, cell, times = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint8).copy(), np.frombuffer(z, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32)
                word, code = cell // (2 * CLASSES), cell % (2 * CLASSES)
                fit = np.stack([np.bincount(word, times * gain[code, k], len(keys)) for k in range(CLASSES)], 1)
                fit[:, empty] = -np.inf
                best = fit.argmax(1)
                at = np.arange(len(keys))
                go = (fit[at, best] > fit[at, of] + 1e-9) & ((keys >> np.uint64(9)) % np.uint64(2) == turn % 2)
                of[go] = best[go]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x], pa.binary()), pa.array([of.tobytes()], pa.binary())], names=["bucket", "keys", "classes"])

    return found.select("bucket", "keys", "classes", "cells", "counts").mapInArrow(run, "bucket int, keys binary, classes binary")


def _among(known: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Classes of the given keys, which are in order and all known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("keys").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                own, of = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint8)
                keep = np.isin(own, keys)
                yield pa.RecordBatch.from_arrays([pa.array([own[keep].tobytes()], pa.binary()), pa.array([of[keep].tobytes()], pa.binary())], names=["keys", "classes"])

    rows = known.select("keys", "classes").mapInArrow(run, "keys binary, classes binary").collect()
    own, of = joined([r["keys"] for r in rows], np.uint64), joined([r["classes"] for r in rows], np.uint8)
    return of[np.argsort(own)]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(follow: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit: each is moved to where class bigrams are likeliest, until none moves or the sweeps are over."""
    follow = follow.astype(float)
    n = len(follow)
    order = np.argsort(-follow.sum(0), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    one = np.eye(classes)
    right, left = follow @ one[of], follow.T @ one[of]  # unit by class: what follows it, what comes before it
    table = one[of].T @ right
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own, same = of[w], follow[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[own] -= same
            l[own] -= same
            table[own] -= r
            table[:, own] -= l
            table[own, own] -= same
            rows, columns = table.sum(1) + l, table.sum(0) + r  # a mover's neighbours count towards their classes wherever it goes
            out = _f(table + r) - _f(table)
            into = _f(table.T + l) - _f(table.T)
            out[diagonal, diagonal] = into[diagonal, diagonal] = 0
            d = table[diagonal, diagonal]
            gain = (out.sum(1) + into.sum(1) + _f(d + r + l + same) - _f(d)
                    - _f(rows + r.sum() + same) + _f(rows) - _f(columns + l.sum() + same) + _f(columns))
            new = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
            table[new] += r
            table[:, new] += l
            table[new, new] += same
            if new != own:
                moved += 1
                of[w] = new
                right[:, own] -= follow[:, w]
                right[:, new] += follow[:, w]
                left[:, own] -= follow[w]
                left[:, new] += follow[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    """Frequent words with counts and classes, classes of END and of unseen words' endings, and log10 tables of the class model."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    end: int
    endings: np.ndarray
    move: np.ndarray
    below: np.ndarray
    tokens: int
    distinct: int


def train(docs: DataFrame, folds: int, table: DataFrame, n: int) -> tuple[Model, DataFrame]:
    """The model, and (bucket, keys, classes) of every counted word, from ``counts()`` and one more pass over the training texts.

    Units are exchanged first, which gives each word a class to start from: its own unit's or its
    ending's.  Then all words move by their own neighbours in rounds of written tables, as long as
    the class bigrams get likelier, ROUNDS times at most.
    """
    rows = table.select("total", "distinct").collect()
    tokens, distinct = sum(r["total"] for r in rows), sum(r["distinct"] for r in rows)
    keys, number = frequent(table, max(2.0, FREQUENT * tokens))
    units = Units(np.sort(np.union1d(keys[number >= max(2.0, OWN * tokens)], np.zeros(1, np.uint64))))
    if not tokens:
        move = np.full((CLASSES, CLASSES), -np.log10(CLASSES))
        none = table.selectExpr("bucket", "keys", "keys AS classes").limit(0)
        return Model(keys, number, np.zeros(0, np.uint8), 0, np.zeros(ENDINGS, np.int64), move, np.full(CLASSES, np.log10(ADD)), 0, 0), none
    found = stored(coded(docs, folds, keys), "brown-tokens", "zstd")
    start = exchange(pairs(found, keys, units))
    shared = docs.sparkSession.sparkContext.broadcast((units, start))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, of = shared.value
        for batch in batches:
            raw = batch.column("keys").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("keys"), pa.array([of[u.of(np.frombuffer(x, np.uint64))].astype(np.uint8).tobytes() for x in raw], pa.binary())],
                                             names=["bucket", "keys", "classes"])

    known = stored(table.select("bucket", "keys").mapInArrow(begin, "bucket int, keys binary, classes binary"), "brown-classes")
    best, kept = -np.inf, None
    for turn in range(ROUNDS + 1):
        classes = _among(known, keys)
        around = contexts(found, known, keys, classes, n, turn < ROUNDS)
        around = stored(around, "brown-contexts", "zstd") if turn < ROUNDS else around  # after the last round only the class bigrams count
        bigrams = np.sum([np.frombuffer(r["table"], np.int64) for r in around.select("table").collect()], 0).reshape(CLASSES, CLASSES).astype(float)
        likely = _f(bigrams).sum() - _f(bigrams.sum(1)).sum() - _f(bigrams.sum(0)).sum()
        if likely <= best:
            break
        best, kept = likely, (known, classes, bigrams)
        if turn < ROUNDS:
            known = stored(moved(around, bigrams, turn), "brown-classes")
            dropped(around)
    dropped(found)
    known, classes, bigrams = kept
    types = np.sum([np.bincount(np.frombuffer(r["classes"], np.uint8), minlength=CLASSES) for r in known.select("classes").toLocalIterator()], 0)
    move = np.log10((bigrams + ADD) / (bigrams.sum(1, keepdims=True) + ADD * CLASSES))
    below = np.log10(bigrams.sum(0) + ADD * (types + 1))
    return Model(keys, number, classes, int(classes[0]), start[len(units.keys):], move, below, tokens, distinct), known


LOCAL = np.dtype([("key", np.uint64), ("doc", np.int64), ("null", np.bool_), ("held", np.bool_), ("n", np.int64), ("known", np.int64), ("base", float)])
#: A word of a text whose class was looked up: key of the text, place in it, class.
PLACE = np.dtype([("key", np.uint64), ("place", np.uint32), ("of", np.uint8)])
PART = np.dtype([("key", np.uint64), ("known", np.int64), ("log", float)])


def score(docs: DataFrame, folds: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, one row per row.

    Null and empty texts are the end alone.  A null id counts as empty text when the folds are drawn.
    Rows with the same id and text get the same scores.  Without training texts every word is unknown.
    """
    n_buckets = buckets(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(counts(docs, folds, n_buckets), "brown-counts")
    model, classes = train(docs, folds, table, n_buckets)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.counts + ADD)
        for batch in slices(batches, "text", 1000):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            word, found, many = tokenised(texts)
            word, many = np.append(word, np.uint64(END)), many + 1  # each text's end is its last token
            start = np.cumsum(many) - many
            row = np.repeat(np.arange(len(ids)), many)
            token = np.full(len(row), len(word) - 1)
            token[np.arange(len(found)) + np.repeat(np.arange(len(ids)), many - 1)] = found
            at = np.searchsorted(m.keys, word)
            at[at == len(m.keys)] = 0
            often, log = np.zeros(len(word), bool), np.zeros(len(word))
            of = m.endings[(word & np.uint64(ENDINGS - 1)).astype(np.int64)].astype(np.uint8)
            if len(m.keys):
                often = m.keys[at] == word
                log[often], of[often] = logs[at[often]], m.classes[at[often]]
            rows = np.zeros(len(ids), LOCAL)
            raw = pc.fill_null(texts.cast(pa.string()).cast(pa.binary()), b"").to_numpy(zero_copy_only=False)
            rows["key"] = [xxhash.xxh64_intdigest(f"{d}:".encode() + t) for d, t in zip(ids, raw, strict=True)]
            rows["doc"], rows["null"], rows["held"] = [d or 0 for d in ids], [d is None for d in ids], [in_fold(d, folds) for d in ids]
            rows["n"], rows["known"], rows["base"] = many, np.add.reduceat(often[token], start, dtype=np.int64), np.add.reduceat(log[token], start)
            own, out = of[token].tobytes(), []
            order = np.argsort(rows["key"] % np.uint64(n_buckets), kind="stable")
            to = (rows["key"][order] % np.uint64(n_buckets)).astype(np.int64)
            for group in np.split(order, np.flatnonzero(np.diff(to)) + 1):
                out.append((int(rows["key"][group[0]] % np.uint64(n_buckets)), 0, rows[group].tobytes(),
                            b"".join(own[start[k]:start[k] + many[k]] for k in group), b""))
            rare = np.flatnonzero(~often[token])
            other, pair = word[token[rare]], np.stack([row[rare], rare - start[row[rare]]], 1).astype(np.uint32)
            for b, raw in cut([other, pair], _bucket(other, n_buckets), n_buckets):
                pair = np.frombuffer(raw[1], np.uint32).reshape(-1, 2)
                first = np.concatenate([[True], pair[1:, 0] != pair[:-1, 0]])  # rows are in order
                out.append((b, 1, raw[0], rows["key"][pair[first, 0]].tobytes(), np.stack([np.cumsum(first) - 1, pair[:, 1]], 1).astype(np.uint32).tobytes()))
            yield _batch(out)

    def meet(known: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keep = found["kind"] == 0
        out = [(b, 0, a, c) for b, a, c in zip(found["bucket"][keep], found["a"][keep], found["b"][keep], strict=True)]
        words_, number, of = joined(known["keys"], np.uint64), joined(known["counts"], np.int64), joined(known["classes"], np.uint8)
        key, log, hit, places = [], [], [], []
        for a, b, c in zip(*(found[x][~keep] for x in "abc"), strict=True):
            word, pair = np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint32).reshape(-1, 2)
            at = np.searchsorted(words_, word)
            at[at == len(words_)] = 0
            seen = words_[at] == word if len(words_) else np.zeros(len(word), bool)
            n = np.where(seen, number[at], 0) if len(words_) else np.zeros(len(word), np.int64)
            key.append(np.frombuffer(b, np.uint64))
            log.append(np.bincount(pair[:, 0], np.log10(n + ADD), minlength=len(key[-1])))
            hit.append(np.bincount(pair[:, 0], n > 0, minlength=len(key[-1])))
            if len(words_):  # the others keep the class of their ending, which their texts already have
                seen &= of[at] != shared.value.endings[(word & np.uint64(ENDINGS - 1)).astype(np.int64)]
            place = np.zeros(int(seen.sum()), PLACE)
            place["key"], place["place"] = key[-1][pair[seen, 0]], pair[seen, 1]
            place["of"] = of[at[seen]] if len(words_) else 0
            places.append(place)
        if key:
            rows = np.zeros(sum(map(len, key)), PART)
            rows["key"], rows["log"], rows["known"] = (np.concatenate(x) for x in (key, log, hit))
            out += [(b, 1, raw, b"") for b, (raw,) in cut([rows], (rows["key"] % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
            rows = np.concatenate(places)
            out += [(b, 2, raw, b"") for b, (raw,) in cut([rows], (rows["key"] % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
        return pd.DataFrame(out, columns=["part", "kind", "rows", "classes"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        rows, parts, places = (joined(group["rows"][group["kind"] == k], t) for k, t in ((0, LOCAL), (1, PART), (2, PLACE)))
        own = np.frombuffer(b"".join(group["classes"][group["kind"] == 0]), np.uint8).copy()
        key, log = summed(parts["key"], parts["log"])
        _, known = summed(parts["key"], parts["known"])
        texts, first, back, times = np.unique(rows["key"], return_index=True, return_inverse=True, return_counts=True)
        start = np.cumsum(rows["n"]) - rows["n"]
        own[start[first[np.searchsorted(texts, places["key"])]] + places["place"]] = places["of"]
        before = np.concatenate([[m.end], own[:-1]]).astype(np.int64)
        before[start] = m.end
        chain = np.add.reduceat(m.move[before, own] - m.below[own], start)[first][back]  # of rows that repeat, the first has all classes
        at = np.searchsorted(key, rows["key"])
        at[at == len(key)] = 0
        hit = key[at] == rows["key"] if len(key) else np.zeros(len(rows), bool)
        log, known = ((np.where(hit, x[at], 0) if len(key) else np.zeros(len(rows))) / times[back] for x in (log, known))
        base = rows["base"] + log
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(rows["doc"].copy(), rows["null"].copy()),
                             "held_out": rows["held"], "n_tokens": rows["n"], "n_known": rows["known"] + np.rint(known).astype(np.int64),
                             "train_tokens": np.full(len(rows), m.tokens), "base_score": base - rows["n"] * np.log10(m.tokens + ADD * (m.distinct + 1)),
                             "score": base + chain})

    found = docs.mapInArrow(scan, "bucket int, kind int, a binary, b binary, c binary")
    known = table.select("bucket", "keys", "counts").join(classes.select("bucket", "classes"), "bucket", "left")
    met = known.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(meet, "part int, kind int, rows binary, classes binary")
    return met.groupBy("part").applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
