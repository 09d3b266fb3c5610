"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one valid last token: the one that fits after the last token of
the prefix it leaves.  So the table of last tokens grows by appending bytes, survives at the front of
an edit, and is walked backwards to read the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Prefixes, pieces and words whose encoding a Python worker remembers before it starts afresh.
CACHE_PREFIXES = 200_000
CACHE_PIECES = 150_000
CACHE_WORDS = 200_000
#: Below it, letters are letters in every Unicode version.
LATIN_END = "\u0250"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Ranks (tokens in order of merging) with the tables that the prefixes need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: longest token by its last three bytes: where to begin looking for the last token of a prefix
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self.reach[token[-3:]] = max(self.reach.get(token[-3:], 2), len(token))
        self.packed = {r: r.to_bytes(4, "little") for r in self.bytes_of}
        self._last: dict[bytes, int] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fit: dict[tuple[int, int], bool] = {}

    @classmethod
    def parse(cls, data: bytes) -> Encoder:
        rows = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in rows})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; (-1, -1) if merging never gives it, None for one byte."""
        if token in self._halves:
            return self._halves[token]
        whole = self.bytes_of[token]
        out = None
        if len(whole) > 1:
            parts = [whole[i:i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            out = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        self._halves[token] = out
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens.

        Merges are taken back from the latest; at each step a merge across the seam that would have
        come earlier speaks against the pair.
        """
        key = (a, b)
        known = self._fit.get(key)
        if known is not None:
            return known
        limit, found = 1 << 60, None
        ranks, text = self.ranks, self.bytes_of
        while found is None:
            across = ranks.get(text[a] + text[b])
            if across is not None and across < limit:
                found = False
                break
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                found = True
            elif right is None or (left is not None and a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]
        if len(self._fit) >= 300_000:
            self._fit.clear()
        self._fit[key] = found
        return found

    def last_token(self, prefix: bytes) -> int:
        """The last token of a byte string; what it asks of shorter prefixes is remembered for other strings too."""
        known = self._last.get(prefix)
        if known is not None:
            return known
        get, fit, end = self.ranks.get, self._fit, len(prefix)
        start = end - self.reach.get(prefix[-3:], 2)
        for start in range(start if start > 0 else 0, end):
            token = get(prefix[start:])
            if token is None or self.halves(token) == (-1, -1):
                continue
            if start:
                before = self.last_token(prefix[:start])
                fits = fit.get((before, token))
                if fits is None:
                    fits = self.fits(before, token)
            if not start or fits:
                if len(self._last) >= CACHE_PREFIXES:
                    self._last.clear()
                self._last[prefix] = token
                return token
        raise ValueError("the ranks lack a byte")

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece; one that is a token as it stands is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return Prefixes(self, piece).tokens()
        out = []
        while piece:
            out.append(self.last_token(piece))
            piece = piece[:-len(self.bytes_of[out[-1]])]
        return out[::-1]


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> int:
        encoder, data, last = self.encoder, self.data, self.last
        get = encoder.ranks.get
        for start in range(max(0, end - encoder.reach.get(data[max(0, end - 3):end], 2)), end):
            token = get(data[start:end])
            if token is not None and encoder.halves(token) != (-1, -1) and (
                    start == 0 or encoder.fits(last[start], token)):
                return token
        raise ValueError("the ranks lack a byte")

    def replace(self, at: int, drop: int, new: bytes) -> int:
        """Swaps ``drop`` bytes at ``at`` for ``new``; returns how many prefixes were worked out again.

        Once as many prefixes in a row agree with the old table as a token is long, so does the rest.
        """
        old, rest = self.last, self.data[at + drop:]
        self.data = self.data[:at] + new + rest
        self.last = old[:at + 1]
        shift, same = len(new) - drop, 0
        for end in range(at + 1, len(self.data) + 1):
            if end >= at + len(new) and same >= self.encoder.longest:
                self.last += old[end - shift:]
                return end - 1 - at
            token = self._last(end)
            self.last.append(token)
            same = same + 1 if end > at + len(new) and old[end - shift] == token else 0
        return len(self.data) - at

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.encoder.bytes_of[self.last[end]])
        return out[::-1]


class Pieces(dict):
    """Piece of text to its ids as little-endian 32-bit numbers."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        encoder = self.encoder
        packed = b"".join(map(encoder.packed.__getitem__, encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Words(dict):
    """A run without spaces, to the ids of one space and the run.

    No piece holds a space behind another character, so a text falls apart before every single
    space.  Runs next to more white space have no such place; asking for one raises KeyError.
    """

    def __init__(self, pieces: Pieces, pattern: str):
        super().__init__()
        self.pieces, self.split = pieces, regex.compile(pattern).findall

    def __missing__(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise KeyError(run)
        if run.isalpha() and max(run) < LATIN_END:
            packed = self.pieces[" " + run]
        elif run[-1] in ".," and len(run) > 1 and run[-2].isalpha() and max(run) < LATIN_END:
            packed = self[run[:-1]] + self.pieces[run[-1]]
        else:
            packed = self.whole(" " + run)
        if len(run) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[run] = packed
        return packed

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        runs = text.split(" ")
        first = runs[0]
        if first and first[-1].isspace():
            return self.whole(text)
        try:
            rest = b"".join(map(self.__getitem__, runs[1:]))
        except KeyError:
            return self.whole(text)
        return self.whole(first) + rest


class Vocabulary:
    """Bytes of every id in one array, to decode many ids at once."""

    def __init__(self, encoder: Encoder):
        tokens = [encoder.bytes_of.get(i, b"") for i in range(max(encoder.bytes_of) + 1)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


_ready: dict[str, tuple[Encoder, Words, Vocabulary]] = {}


def ready(data: bytes, pattern: str) -> tuple[Encoder, Words, Vocabulary]:
    """Encoder, word memory and vocabulary of a rank file, made once for a Python worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _ready:
        encoder = Encoder.parse(data)
        _ready[key] = encoder, Words(Pieces(encoder), pattern), Vocabulary(encoder)
    return _ready[key]


def _fields(df: DataFrame, names: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + list(more))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
           text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens (long) and ids (binary, little-endian 32-bit numbers) of every whole text.

    Each match of ``pattern`` is encoded apart; null and empty texts give no ids; other columns are
    not read, so their names can't clash.  The rank file is read by the driver and sent as it is: a
    vocabulary, whose size doesn't follow the data.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = ready(ranks.value, pattern)[1].encode
        for batch in _slices(batches):
            ids = [encoded(t) if t else b"" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=names + ["n_tokens", "ids"])

    out = _fields(df, names, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()))
    return df.select(*names, text).mapInArrow(run, out)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The table with ``decoded`` (binary): the bytes of the ids; null ids give empty bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    df = df.drop("decoded")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ready(ranks.value, "")[2]
        for batch in _slices(batches):
            out = [vocabulary.decode(np.frombuffer(x, "<u4")) if x else b""
                   for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(out, pa.binary())], names=names + ["decoded"])

    return df.mapInArrow(run, _fields(df, names, T.StructField("decoded", T.BinaryType())))
