"""Exact substring dedup over a sampled suffix array.

Of every 50-byte string one place is an anchor: where its least hashed 16-byte head starts.  Equal
strings have their anchor at the same place, so suffixes need sorting only from anchors.  Sampled
splitters deal the suffixes by their hashed heads; a bucket sorts by head, then by what surrounds
it, then by document, and compares neighbours.  Heads that a splitter cuts count as met on both
sides.  Anchors whose whole surroundings also start in an earlier document are done; where only the
head is shared, the 50-byte strings around it are sorted and compared in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, dropped, joined, mixed, stored

#: Bytes of a repeated string and of a head; heads that a string has.
LENGTH, HEAD = 50, 16
WINDOW = LENGTH - HEAD + 1
#: Bytes that are hashed at a time; one document in so many is read for the splitters; bits of the document filter.
SLICE, SAMPLED, FILTER_BITS = 1 << 21, 64, 27
#: Rows of a slice at most: they are numbered in 16 bits.
ROWS = 50_000
#: Bytes of text whose anchors make up a bucket on average; a session that shuffles into more parts has smaller buckets.
BUCKET = 12 << 20
#: Bytes that a string has in common with another on one side of its anchor at least, besides the head.
SIDE = (LENGTH - HEAD + 1) // 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What becomes of an anchor: all its strings go, its strings are to be compared, they only serve as earlier ones.
GONE, OPEN, EARLIER = 0, 1, 2


def _grams(b: np.ndarray, p: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 16-byte and all 50-byte strings."""
    power = [p]
    h = b.astype(np.uint64) + np.uint64(1)
    kept = {1: h}
    for n in (1, 2, 4, 8, 16):
        h = h[:-n] * power[-1] + h[n:]
        kept[2 * n] = h
        power.append(np.uint64(int(power[-1]) ** 2 % 2 ** 64))
    p16, p2 = power[4], power[1]
    long = kept[32][:-16] * p16 + kept[16][32:]
    long = long[:-2] * p2 + kept[2][48:]
    return kept[16], long


class Text:
    """Anchors of some documents' bytes: place, first and last string, and hashes of head and surroundings."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        b = np.frombuffer(b"".join(texts), np.uint8)
        assert len(b) < 1 << 24, "a place has 24 bits"
        self.row = self.first = self.last = np.zeros(0, np.int64)
        self.head = self.around = self.strings = np.zeros(0, np.uint64)
        self.left = self.right = np.zeros(0, np.uint16)
        if len(b) < LENGTH:
            return
        heads, self.strings = _grams(b, _A)
        heads = mixed(heads)
        at = (heads & ~np.uint64((1 << 24) - 1)) | np.arange(len(heads), dtype=np.uint64)
        width, least = 1, at
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:len(at) - WINDOW + 1], least[WINDOW - width:][:len(at) - WINDOW + 1])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # of each string, by its start
        row = np.repeat(np.arange(len(texts)), self.sizes)[:len(anchor)]
        inside = np.arange(len(anchor)) + LENGTH <= self.starts[row + 1]
        start = np.flatnonzero(inside)
        new = np.concatenate([[True], (anchor[start[1:]] != anchor[start[:-1]]) | (row[start[1:]] != row[start[:-1]])]) if len(start) else np.zeros(0, bool)
        k = np.flatnonzero(new)
        self.first = start[k]
        self.last = start[np.append(k[1:], len(start)) - 1] if len(k) else self.first
        self.row = row[self.first]
        place = anchor[self.first]
        self.head = heads[place] >> np.uint64(16)
        # a string that starts elsewhere too has half of its other bytes in common there, before or behind the head
        self.left = (mixed(heads[np.maximum(place - SIDE, 0)] * _B + heads[place]) >> np.uint64(48)).astype(np.uint16)
        self.right = (mixed(heads[np.minimum(place + SIDE, len(heads) - 1)] * _B + heads[place]) >> np.uint64(48)).astype(np.uint16)
        shape = ((self.last - self.first) << 8 | (place - self.first)).astype(np.uint64)
        self.around = mixed(self.strings[self.first] * _A + self.strings[self.last] * _B + shape)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of the strings of the given anchors."""
        n = self.last[which] - self.first[which] + 1
        return np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def slices(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Columns of rows that together hold about SLICE bytes of text, the text as bytes last."""
    for batch in batches:
        columns, held = [[] for _ in (*names, "text")], 0
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            for values in zip(*(part.column(c).to_pylist() for c in (*names, "text")), strict=True):
                text = (values[-1] or "").encode("utf-8", "surrogatepass")
                if held and (held + len(text) > SLICE or len(columns[0]) >= ROWS):
                    yield columns
                    columns, held = [[] for _ in columns], 0
                for column, value in zip(columns, (*values[:-1], text), strict=True):
                    column.append(value)
                held += len(text)
        if columns[0]:
            yield columns


def _pieces(text: bytes) -> list[tuple[int, bytes]]:
    """A text too long for one slice as parts that overlap by a string less one byte."""
    step = 8 << 20
    return [(0, text)] if len(text) <= step else [(s, text[s:s + step + LENGTH - 1]) for s in range(0, len(text) - LENGTH + 1, step)]


def parts(docs: DataFrame) -> int:
    """Buckets of anchors and groups of documents, and tasks that they go to: what one holds is bounded, however many documents there are."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(buckets(docs.sparkSession), -(-total // BUCKET))


def splitters(docs: DataFrame, n: int) -> np.ndarray:
    """n - 1 heads that part a sample of all anchors evenly; a frequent head appears more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in (c for found in slices(batches, "doc_id") for c in _chunks(*found)):
            head = Text(texts).head
            head = head[mixed(head + np.arange(len(head), dtype=np.uint64)) % np.uint64(16) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(head.astype(np.int64))], names=["head"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(run, "head long")
    heads = np.sort(np.array([r["head"] for r in sample.orderBy(F.xxhash64("head"), "head").limit(max(20_000, 8 * n)).collect()], np.int64).astype(np.uint64))
    return heads[np.linspace(0, len(heads) - 1, n + 1).astype(int)[1:-1]] if len(heads) >= n else np.linspace(0, 2 ** 48, n + 1)[1:-1].astype(np.uint64)


def _least(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, most significant first, and where a new value of all but the last begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys[:-1]:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


#: A string on its way to its bucket: hash, part of a second hash, number of its document in the blob.
_STRING = np.dtype([("one", "<u8"), ("two", "<u4"), ("row", "<u4")])


def _ends(of: np.ndarray, side: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest document among the rows with the same head and side."""
    key = of.astype(np.uint64) << np.uint64(16) | side
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(at, len(key)))
    low, high = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    low[order], high[order] = (np.repeat(f.reduceat(doc[order], at), size) for f in (np.minimum, np.maximum))
    return low, high


_BLOB = "bucket int, kind int, docs binary, a binary, b binary"
#: An anchor on its way to its bucket: head in 32 and 16 bits, surroundings, both sides, number of its document in the blob.
_ANCHOR = np.dtype([("head", "<u4"), ("more", "<u2"), ("around", "<u8"), ("left", "<u2"), ("right", "<u2"), ("row", "<u2")])


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                      names=["bucket", "kind", "docs", "a", "b"])


def _group(doc: np.ndarray, n: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "docs", "a", "b"])


def anchors(docs: DataFrame, cuts: np.ndarray, n: int) -> DataFrame:
    """Anchors of all documents dealt by head; of equal surroundings that a slice holds, the least document's."""
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (c for found in slices(batches, "doc_id") for c in _chunks(*found)):
            known = [k for k, d in enumerate(ids) if d is not None]
            found = Text([texts[k] for k in known])
            if not len(found.head):
                continue
            doc = np.array([ids[k] for k in known], np.int64)[found.row]
            order, new = _least(found.head, found.around, doc)
            head, around, doc = found.head[order], found.around[order], doc[order]
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = doc > least
            rows = [(b, 10 + GONE, x, y, b"") for b, (x, y) in cut([doc[gone], (head ^ around)[gone]], _group(doc[gone], n), n)]
            order, head, around, doc = order[new], head[new], around[new], doc[new]
            packed = np.zeros(len(order), _ANCHOR)
            packed["head"], packed["more"], packed["around"] = head >> np.uint64(16), head & np.uint64(0xFFFF), around
            packed["left"], packed["right"] = found.left[order], found.right[order]
            low, high = np.searchsorted(shared.value, head, "left"), np.searchsorted(shared.value, head, "right")
            to = low + (around % (high - low + 1).astype(np.uint64)).astype(np.int64)  # a head that splitters repeat is spread over its buckets
            for b, (x, y) in cut([doc, packed], to, n):
                ids, at = np.unique(np.frombuffer(x, np.int64), return_inverse=True)
                part = np.frombuffer(y, _ANCHOR).copy()
                part["row"] = at
                rows.append((b, 0, ids.tobytes(), part.tobytes(), b""))
            yield _out(rows)

    return docs.mapInArrow(run, _BLOB)


def judged(dealt: DataFrame, cuts: np.ndarray, n: int) -> DataFrame:
    """(document group, kind, documents, anchors): the anchors whose head other documents share, and what becomes of them."""
    shared = dealt.sparkSession.sparkContext.broadcast(cuts)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready = group["kind"] >= 10
        done = list(group[ready].itertuples(index=False, name=None))
        group = group[~ready]
        if not len(group):
            return _frame(done)
        rows = joined(group["a"], _ANCHOR)
        doc = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(a, _ANCHOR)["row"]] for d, a in zip(group["docs"], group["a"], strict=True)])
        head, around = rows["head"].astype(np.uint64) << np.uint64(16) | rows["more"], rows["around"]
        order, new = _least(head, around, doc)
        doc, head, around, left, right = doc[order], head[order], around[order], rows["left"][order], rows["right"][order]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        run_ = np.concatenate([[True], head[1:] != head[:-1]])
        at = np.flatnonzero(run_)
        of = np.cumsum(run_) - 1
        kinds = np.add.reduceat(new.astype(np.int64), at)[of]
        met = np.isin(head, shared.value)
        before, behind = (_ends(of, side, doc) for side in (left, right))
        opened = (doc > before[0]) | (doc > behind[0]) | met
        earlier = (doc < before[1]) | (doc < behind[1]) | met
        status = np.where(doc > least, GONE, np.where(opened, OPEN, EARLIER))
        # with one kind of surroundings there is nothing left to compare, nor where no other document shares a side
        keep = (status == GONE) | ((kinds > 1) | met) & (opened | earlier) & new
        return _frame(done + [(b, 10 + s, x, y, b"") for s in (GONE, OPEN, EARLIER) for pick in [keep & (status == s)]
                       for b, (x, y) in cut([doc[pick], (head ^ around)[pick]], _group(doc[pick], n), n)])

    return dealt.repartition(n, "bucket").groupBy("bucket").applyInPandas(run, _BLOB)


def flagged(docs: DataFrame, news: DataFrame, n: int) -> DataFrame:
    """(bucket, doc_id, bytes, size, sha): every document by one of ``n`` groups; the bytes only of those in ``news``.

    Their ids set bits of a filter of fixed size; what it lets through by chance is moved in vain, no more.
    """
    spark, size = docs.sparkSession, 1 << FILTER_BITS
    n_parts = 64

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            for raw in batch.column("docs").to_pylist():
                at = mixed(np.unique(np.frombuffer(raw, np.uint64))) % np.uint64(size)
                np.bitwise_or.at(on, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array([x.tobytes() for x in on.reshape(n_parts, -1)], pa.binary())], names=["part", "bits"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [group["part"].iat[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"]]).tobytes()]})

    on = np.zeros((n_parts, size // 8 // n_parts), np.uint8)
    for r in news.select("docs").mapInArrow(bits, "part int, bits binary").groupBy("part").applyInPandas(add, "part int, bits binary").collect():
        on[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(on.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, "doc_id"):
            doc = np.array([d or 0 for d in ids], np.int64)
            at = (mixed(doc.astype(np.uint64)) % np.uint64(size)).astype(np.int64)
            on = (shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) & np.array([d is not None for d in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_group(doc, n), pa.int32()), pa.array(ids, pa.int64()), pa.array([t if o else None for t, o in zip(texts, on, strict=True)], pa.binary()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([None if o else hashlib.sha256(t).hexdigest() for t, o in zip(texts, on, strict=True)], pa.string())],
                names=["bucket", "doc_id", "bytes", "size", "sha"])

    return docs.mapInArrow(run, "bucket int, doc_id long, bytes binary, size long, sha string")


def _members(found: Text, doc: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which anchors are among the given (document, anchor) pairs."""
    own = mixed(found.head ^ found.around) + mixed(doc[found.row].astype(np.uint64)) * _B
    return np.isin(own, mixed(ids) + mixed(docs.astype(np.uint64)) * _B)


def compared(texts: DataFrame, news: DataFrame, n: int) -> DataFrame:
    """Strings of the open and the earlier anchors dealt by hash; what one group settles goes out as settled."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[left["bytes"].notna()]
        kind = right["kind"].to_numpy()
        pairs = {k: (joined(right["docs"][kind == 10 + k], np.int64), joined(right["a"][kind == 10 + k], np.uint64)) for k in (OPEN, EARLIER)}
        one, two, doc, opened = [], [], [], []
        for ids, chunk in _chunks(left["doc_id"], left["bytes"]):
            found = Text(chunk)
            d = np.array(ids, np.int64)
            is_open = _members(found, d, *pairs[OPEN])
            use = np.flatnonzero(is_open | _members(found, d, *pairs[EARLIER]))
            if len(use):
                at = found.windows(use)
                rows = np.repeat(use, found.last[use] - found.first[use] + 1)
                one.append(mixed(found.strings[at]))
                two.append((mixed(_grams(np.frombuffer(b"".join(chunk), np.uint8), _B)[1][at]) >> np.uint64(32)).astype(np.uint32))
                doc.append(d[found.row[rows]])
                opened.append(is_open[rows])
        if not one:
            return _frame([])
        one, two, doc, opened = (np.concatenate(x) for x in (one, two, doc, opened))
        order, new = _least(one, two, doc)
        one, two, doc, opened = one[order], two[order], doc[order], opened[order]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = doc > least
        rows = [(b, 20, x, y, b"") for b, (x, y) in cut([doc[gone], one[gone]], _group(doc[gone], n), n)]
        # of one string's rows in a group only the least document's can still be open or serve as earlier one
        packed = np.zeros(int(new.sum()), _STRING)
        packed["one"], packed["two"] = one[new], two[new]
        for b, (x, y) in cut([doc[new], packed], (one[new] % np.uint64(n)).astype(np.int64), n):
            ids, at = np.unique(np.frombuffer(x, np.int64), return_inverse=True)
            part = np.frombuffer(y, _STRING).copy()
            part["row"] = at
            rows.append((b, 30, ids.tobytes(), part.tobytes(), b""))
        return _frame(rows)

    news = news.where(f"kind IN ({10 + OPEN}, {10 + EARLIER})").repartition(n, "bucket")
    return texts.repartition(n, "bucket").groupBy("bucket").cogroup(news.groupBy("bucket")).applyInPandas(run, _BLOB)


def _chunks(docs: Iterable, whole: Iterable[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """The texts' pieces with their documents, about SLICE bytes or one piece at a time."""
    ids, texts, held = [], [], 0
    for d, t in zip(docs, whole, strict=True):
        for _, p in _pieces(t):
            ids.append(d if d is None else int(d))
            texts.append(p)
            held += len(p)
            if held > SLICE:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def settled(strings: DataFrame, n: int) -> DataFrame:
    """The strings that also start in an earlier document, by document group."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready = group["kind"] == 20
        done = list(group[ready].itertuples(index=False, name=None))
        group = group[~ready]
        if not len(group):
            return _frame(done)
        rows = joined(group["a"], _STRING)
        doc = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(a, _STRING)["row"]] for d, a in zip(group["docs"], group["a"], strict=True)])
        one, two = rows["one"], rows["two"]
        order, new = _least(one, two, doc)
        doc, one = doc[order], one[order]
        gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        return _frame(done + [(b, 20, x, y, b"") for b, (x, y) in cut([doc[gone], one[gone]], _group(doc[gone], n), n)])

    return strings.repartition(n, "bucket").groupBy("bucket").applyInPandas(run, _BLOB)


def spans(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that strings at the given starts, in order, cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH


def _by_doc(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents in order and what was sent to each."""
    doc, sent = joined(rows["docs"], np.int64), joined(rows["a"], np.uint64)
    order = np.argsort(doc, kind="stable")
    return doc[order], sent[order]


def _of(sent: tuple[np.ndarray, np.ndarray], doc: int) -> np.ndarray:
    return sent[1][slice(*np.searchsorted(sent[0], [doc, doc + 1]))]


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and begins and ends of the removed spans, of every document.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id;
    strings are judged on the input.  Null and empty texts have no bytes.  Rows that share an id
    don't count against each other; a null id is neither removed from nor counted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts(docs)
    cuts = splitters(docs, n)
    news = stored(judged(anchors(docs, cuts, n), cuts, n), "suffix-news")
    strings = compared(flagged(docs, news.where(f"kind <> {10 + GONE}"), n), news, n)
    gone = stored(news.where(f"kind = {10 + GONE}").union(settled(strings, n)), "suffix-gone")
    dropped(news)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kind = right["kind"].to_numpy()
        whole = _by_doc(right[kind == 10 + GONE])
        single = _by_doc(right[kind == 20])
        out = []
        for doc, raw, size, sha in zip(left["doc_id"], left["bytes"], left["size"], left["sha"], strict=True):
            doc = None if pd.isna(doc) else int(doc)
            if raw is None:
                out.append((doc, size, 0, 0, sha, [], []))
                continue
            starts = []
            for offset, piece in _pieces(raw):
                found = Text([piece])
                mark = np.zeros(len(found.strings), bool)
                mark[found.windows(np.flatnonzero(np.isin(found.head ^ found.around, _of(whole, doc))))] = True
                alone = _of(single, doc)
                if len(alone):
                    mark |= np.isin(mixed(found.strings), alone)
                starts.append(np.flatnonzero(mark) + offset)
            begin, end = spans(raw, np.unique(np.concatenate(starts)))
            kept, last = [], 0
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                kept.append(raw[last:b])
                last = e
            kept.append(raw[last:])
            out.append((doc, size, int((end - begin).sum()), len(begin), hashlib.sha256(b"".join(kept)).hexdigest(), begin.tolist(), end.tolist()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"]).astype({"doc_id": "Int64"})

    return flagged(docs, gone, n).repartition(n, "bucket").groupBy("bucket").cogroup(gone.repartition(n, "bucket").groupBy("bucket")).applyInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>")
