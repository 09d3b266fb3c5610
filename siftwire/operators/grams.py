"""Counting of n-grams by chunks of texts: numpy over Arrow tables inside the tasks.

A text has some twenty times its size in grams, so neither the grams of single messages nor a join on them
may cross a shuffle.  Messages are dealt by id into chunks of bounded text; a chunk's grams are numbered once,
counted as numbers, and only its distinct grams travel: to add up document frequencies, or to fetch a
vocabulary's columns, which then meet the chunk's texts again.  They travel packed: a chunk's grams are dealt
by hash into parts, and those of one part are one compressed blob; what a table knows of them goes back
without the grams, in their order.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Characters of text in a chunk, on average, and in one of a small table, which is dealt over all tasks; rows of an Arrow batch.
CHUNK, LEAST, ROWS = 1 << 21, 1 << 20, 1 << 18
#: Chunks whose distinct grams make up a part on average; rows of a table that are packed together.
PER_PART, PACKED = 8, 1 << 20
BIAS = "bias"  # kind of the constant feature every message carries


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their ``times`` (1 each if not given)."""
    if not len(keys):
        return keys, keys
    if times is None:
        keys = np.sort(keys)
    else:
        # a key and its number share a word where they fit: numbers sort several times faster than their places
        room = int(times.max()) + 1
        if int(keys.max()) < (1 << 62) // room:
            keys, times = np.divmod(np.sort(keys * room + times), room)
        else:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]) if times is None else np.add.reduceat(times, first)


@lru_cache(maxsize=None)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is of the class of words (``rx.WORD``), and of that of white space (``rx.SPACE``)."""
    names = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    word = np.array([n[0] in "LN" for n in names])
    space = np.array([n[0] == "Z" for n in names])
    word[ord("_")] = True
    space[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85]] = True
    return word, space


def pieces(texts: pa.ChunkedArray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Given a class by code point, row and code of every run of its characters, and the runs by code; null texts are empty."""
    rows = [x or "" for x in texts.to_pylist()]
    whole = "\n".join([*rows, ""])  # of neither class's runs
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in rows])

    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        inside = np.concatenate([[False], of[points], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        found = pa.array([whole[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)], pa.string()).dictionary_encode()
        return np.searchsorted(ends, edges[::2], "right"), found.indices.to_numpy().astype(np.int64), found.dictionary

    return runs


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and the number of every place's key."""
    room = max(len(keys), 1).bit_length()
    if len(keys) and int(keys.max()) >> (62 - room):
        return np.unique(keys, return_index=True, return_inverse=True)
    # a key and its place share a word: numbers sort several times faster than their places
    both = np.sort(keys << room | np.arange(len(keys)))
    at, keys = both & ((1 << room) - 1), both >> room
    new = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
    number = np.empty(len(keys), np.int64)
    number[at] = np.cumsum(new) - 1
    return keys[new], at[new], number


def split(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word between white space, and the words by code; ``str.split`` knows the same white space as ``classes``."""
    rows = [(x or "").split() for x in texts.to_pylist()]
    found = pa.array([w for row in rows for w in row], pa.string()).dictionary_encode()
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), found.indices.to_numpy().astype(np.int64), found.dictionary


def windows(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of every padded word: number of windows by word, their codes one word after the other, the windows by code.

    Windows are named step by step, one character longer each time, by pairs of numbers: equal names are equal windows.
    Codes go by length, then by character, whatever the order of the words.
    """
    low, high = t.WINDOWS
    whole = "".join(f" {w} " for w in words.to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters, _, points = numbered(points)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)  # end of the word that a place lies in
    word = np.repeat(np.arange(len(sizes)), sizes)
    at, name = np.arange(len(points)), points
    grams, of, codes, known = [], [], [], 0
    for n in range(2, high + 1):
        keep = at + n <= ends[at]
        at, name = at[keep], name[keep]
        _, first, name = numbered(name * len(letters) + points[at + n - 1])
        if n >= low:
            grams += [whole[a:a + n] for a in at[first].tolist()]
            of.append(word[at])
            codes.append(name + known)
            known += len(first)
    of, codes = np.concatenate(of), np.concatenate(codes)
    order = np.argsort(of, kind="stable")
    return np.bincount(of, minlength=len(sizes)), codes[order], grams


def spread(each: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The places of runs that are ``each`` long from ``start`` on, one run after the other."""
    return np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - start, each)


def parts(each: np.ndarray) -> Iterator[slice]:
    """Neighbouring rows whose ``each`` add up to some ``ROWS`` at a time; a larger one is alone or last."""
    upto = np.cumsum(each)
    edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, ROWS), "right"), len(each)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield slice(a, b)


def found_in(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of every value in ``among``, -1 if it isn't there."""
    return pc.fill_null(pc.index_in(values.cast(pa.string()), among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Counted:
    """The cells of a chunk: message, gram and count, cells in order of message and gram; ``grams`` and ``kinds`` by gram.

    ``rows`` is the message by row of the chunk.  Grams are the ``n_tokens`` tokens, then their ``pairs`` (first * ``n_tokens`` + second, in order).
    """

    ids: pa.Array
    message: np.ndarray
    gram: np.ndarray
    tf: np.ndarray
    grams: pa.Array
    kinds: np.ndarray
    rows: np.ndarray
    n_tokens: int
    pairs: np.ndarray

    KINDS = pa.array(["word", "char", BIAS])

    def kind(self, gram: np.ndarray) -> pa.Array:
        return self.KINDS.take(pa.array(self.kinds[gram]))


@dataclass
class Cut:
    """A chunk's texts cut into grams.  ``grams`` and ``kinds``, by gram, are the same in the same order whenever the chunk is cut."""

    tokens: pa.Array
    row: np.ndarray  # of every token, with its code
    code: np.ndarray
    pairs: np.ndarray
    next_to: np.ndarray  # places of tokens with one after them in their row, and the number of that pair
    pair: np.ndarray
    words: pa.Array  # words that windows are cut from, with row and code of every word
    row_of: np.ndarray
    word: np.ndarray
    per: np.ndarray  # windows by word, and their codes
    codes: np.ndarray
    grams: pa.Array
    kinds: np.ndarray


def cut(table: pa.Table, of_words: str, of_chars: str) -> Cut:
    """Tokens in order, then their pairs, then windows; last the constant feature.  Tokens are cut once for each distinct word."""
    row_of, word, words = split(table.column(of_words))
    in_word, token, tokens = pieces(pa.chunked_array([words]))(classes()[0])
    order = pc.sort_indices(tokens).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens, own = tokens.take(pa.array(order)), Runs(in_word, len(words))
    row, code = np.repeat(row_of, own.each[word]), rank[token[own.of(word)]]
    n = max(len(tokens), 1)
    next_to = np.flatnonzero(row[1:] == row[:-1])
    pairs, _, pair = numbered(code[next_to] * n + code[next_to + 1])
    phrases = pc.binary_join_element_wise(tokens.take(pa.array(pairs // n)), tokens.take(pa.array(pairs % n)), " ")
    if of_chars != of_words:
        row_of, word, words = split(table.column(of_chars))
    per, codes, chars = windows(words) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    grams = pa.concat_arrays([tokens.cast(pa.string()), phrases.cast(pa.string()), pa.array([*chars, ""], pa.string())])
    kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(tokens) + len(pairs), len(chars), 1])
    return Cut(tokens, row, code, pairs, next_to, pair, words, row_of, word, per, codes, grams, kinds)


def count(table: pa.Table, names: tuple[str, str, str], with_bias: bool) -> Counted:
    """Counts of a chunk's messages; rows of one id are one message, pairs of words never cross rows."""
    id_col, of_words, of_chars = names
    named = table.column(id_col).combine_chunks().dictionary_encode(null_encoding="encode")
    rows = message = named.indices.to_numpy().astype(np.int64)
    c = cut(table, of_words, of_chars)
    size, n_words = len(c.grams), len(c.tokens) + len(c.pairs)
    found, times = counted(message[c.row_of] * max(len(c.words), 1) + c.word)  # a word's windows are cut once a message
    owner, word = np.divmod(found, max(len(c.words), 1))
    each, start = c.per[word], (np.cumsum(c.per) - c.per)[word]
    place = spread(each, start)
    keys = [message[c.row] * size + c.code, message[c.row[c.next_to]] * size + len(c.tokens) + c.pair, np.repeat(owner, each) * size + n_words + c.codes[place]]
    many = [np.ones(len(keys[0]) + len(keys[1]), np.int64), np.repeat(times, each)]
    if with_bias:
        keys.append(message * size + size - 1)
        many.append(np.ones(len(message), np.int64))
    keys, tf = counted(np.concatenate(keys), np.concatenate(many))
    message, gram = np.divmod(keys, size)
    return Counted(named.dictionary, message, gram, tf, c.grams, c.kinds, rows, len(c.tokens), c.pairs)


# --- grams on their way: numbers and strings as compressed blobs ---------------------------------------------

_ZSTD = pa.Codec("zstd", compression_level=3)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64)]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, one after the other, and where each one ends (from 0 on)."""
    column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    raw = column.buffers()[2] if len(column) else None
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[ends[0]:ends[-1]], ends.astype(np.int64) - ends[0]


def array_of(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings that lie in ``data`` one after the other."""
    ends = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    if ends[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def hashed(column: pa.Array) -> np.ndarray:
    """64 bits of every string: a polynomial of its bytes, scrambled."""
    data, ends = strings(column)
    sizes = np.diff(ends)
    most = int(sizes.max()) if len(sizes) else 0
    if len(_POWERS[0]) < most:
        _POWERS[0] = np.cumprod(np.r_[1, np.full(2 * most, _STEP, np.uint64)].astype(np.uint64))
    value = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][np.arange(len(data)) - np.repeat(ends[:-1], sizes)]
    out, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(value, ends[some])
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def slim(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold them all."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(d).max))


def dumped(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join([np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64).tobytes(), *[a.tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def loaded(blob: bytes) -> list[np.ndarray]:
    raw = _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (2 * n + 1)
    for char, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, chr(char), size, at))
        at += out[-1].nbytes
    return out


def dealt(grams: pa.Array, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams by part, one of ``n`` for each kind: hashes, places in order of part and gram, the parts that have any, where each begins (and the last ends)."""
    hashes = hashed(grams)
    part = (hashes % np.uint64(n)).astype(np.int64) * len(Counted.KINDS) + kinds
    order = np.argsort(part.astype(np.uint16) if n < 1 << 14 else part, kind="stable")  # 16 bits are sorted by their digits
    part = part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:len(part)])
    return hashes, order, part[at], np.r_[at, len(part)]


def shared(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes that every string begins with as the one before it does; none for those at ``starts``."""
    sizes, out = np.diff(ends), np.zeros(len(ends) - 1, np.int64)
    with_one = np.ones(len(sizes), bool)
    with_one[:1] = with_one[starts] = False
    alive, k = np.flatnonzero(with_one), 0
    while len(alive):
        alive = alive[(sizes[alive] > k) & (sizes[alive - 1] > k)]
        alive = alive[data[ends[alive] + k] == data[ends[alive - 1] + k]]
        out[alive] += 1
        k += 1
    return out


def unshared(same: np.ndarray, more: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of strings that lie in ``data`` without the ``same`` first bytes that they share with the one before."""
    sizes = same + more
    ends = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    out[spread(more, ends + same)] = data
    needs = np.flatnonzero(sizes > 0)
    for k in range(int(same.max()) if len(same) else 0):
        needs = needs[sizes[needs] > k]
        own = same[needs] <= k
        # a string that shares this byte follows one that has it
        last = np.maximum.accumulate(np.where(own, np.arange(len(needs)), 0))
        out[ends[needs[~own]] + k] = out[ends[needs[last[~own]]] + k]
    return out, sizes


def packed(grams: pa.Array, kinds: np.ndarray, n: int, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Parts and blobs of grams: sum of their hashes, sizes and bytes without what each shares with the one before, and the ``columns``."""
    hashes, order, found, at = dealt(grams, kinds, n)
    data, ends = strings(grams.take(pa.array(order)))
    same = shared(data, ends, at[:-1])
    more, columns, sums = np.diff(ends) - same, [c[order] for c in columns], hashes[order]
    data, ends = data[spread(more, ends[:-1] + same)], np.r_[0, np.cumsum(more)]
    return found.tolist(), [dumped([sums[a:b].sum(keepdims=True), slim(same[a:b]), slim(more[a:b]), data[ends[a]:ends[b]],
                                    *[c[a:b] if c.dtype.kind == "f" else slim(c[a:b]) for c in columns]])
                            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def unpacked(found: list[list[np.ndarray]]) -> pa.Array:
    """The grams of loaded blobs, one blob after the other."""
    same, more = (together((x[k] for x in found), np.int64) for k in (1, 2))
    return array_of(*unshared(same, more, together((x[3] for x in found), np.uint8)))


def coded(column: np.ndarray) -> list[np.ndarray]:
    """The distinct values and their numbers, or the values alone where most are distinct."""
    known, number = np.unique(column, return_inverse=True)
    return [known, slim(number)] if 2 * len(known) <= len(column) else [column, np.zeros(0, np.uint8)]


def uncoded(known: np.ndarray, number: np.ndarray) -> np.ndarray:
    return known[number] if len(number) else known


def together(arrays: Iterable[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[a.astype(dtype, copy=False) for a in arrays]])


_BLOBS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
_BLOB = "part long, chunk long, blob binary"


def blobs(part: list[int], chunk: list[int | None], blob: list[bytes]) -> pa.Table:
    return pa.table([pa.array(part, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], schema=_BLOBS)


class Runs:
    """Values by word, from (word, value) rows: ``of(words)`` gives the places of their values."""

    def __init__(self, word: np.ndarray, n: int):
        self.each = np.bincount(word, minlength=n)
        self.start = np.cumsum(self.each) - self.each

    def of(self, words: np.ndarray) -> np.ndarray:
        return spread(self.each[words], self.start[words])

    def products(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every value of a left word with every one of the right word at the same place: that place and both values' places, in parts."""
        at, first = np.repeat(np.arange(len(left)), self.each[left]), self.of(left)
        each = self.each[right[at]]
        for s in parts(each):
            yield np.repeat(at[s], each[s]), np.repeat(first[s], each[s]), self.of(right[at[s]])


def pointed(table: pa.Table, of_words: str, c: Counted, kept: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions that the ``kept`` cells point at: where each cell's positions end (from 0 on), and the positions in order.

    A gram of characters points at the words that have it among their windows, a token at the words that hold it.  A pair
    points at a word with a word after it, if that holds the first token and, behind it, the second; and if the
    second is in the word after, at that word as well, unless the word itself also holds it.  Everything that a word points at
    is worked out once for each distinct word, or pair of neighbours, of the chunk.
    """
    word_class = classes()[0]
    row, code, words = split(table.column(of_words))
    if not len(words) or not len(kept):
        return np.zeros(len(kept) + 1, np.int64), np.zeros(0, np.int64)
    n, size, n_words = max(c.n_tokens, 1), len(c.grams), c.n_tokens + len(c.pairs)
    known = np.append(place >= 0, False)  # the last for grams that aren't there
    message, pos = c.rows[row], np.arange(len(row)) - np.searchsorted(row, row, "left")
    cells, room, hits = c.message[kept] * size + c.gram[kept], int(pos.max()) + 2, []

    def point(which: np.ndarray, by: Runs, at: np.ndarray, grams: np.ndarray, wide: np.ndarray | None = None) -> None:
        """Places ``which`` of words point at the grams that ``by`` lists for ``at``; ``wide`` ones point at the next place too."""
        each = by.each[at]
        for s in parts(each):
            listed, many = by.of(at[s]), each[s]
            key = np.repeat(message[which[s]], many) * size + grams[listed]
            cell = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
            there = cells[cell] == key
            cell, here = cell[there], np.repeat(pos[which[s]], many)[there]
            hits.append(cell * room + here)
            if wide is not None:
                more = wide[listed[there]]
                hits.append(cell[more] * room + here[more] + 1)

    # windows and tokens of a word
    per, codes, chars = windows(words)
    of_char = found_in(pa.array(chars, pa.string()), c.grams.slice(n_words, size - n_words - 1))
    of_char = np.where(of_char < 0, size, of_char + n_words)[codes]
    in_word, token, tokens = pieces(pa.chunked_array([words]))(word_class)
    key = in_word * n + found_in(tokens, c.grams.slice(0, c.n_tokens))[token] if len(tokens) else np.zeros(0, np.int64)
    own, first = np.unique(key, return_index=True)
    last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
    holder, held = np.divmod(own, n)
    listed = np.concatenate([np.repeat(np.arange(len(words)), per) * (size + 1) + of_char, holder * (size + 1) + held])
    by, grams = np.divmod(counted(listed[known[listed % (size + 1)]])[0], size + 1)
    point(np.arange(len(row)), Runs(by, len(words)), code, grams)

    # pairs of a word that has one after it
    followed = np.flatnonzero(row[1:] == row[:-1])
    holds = Runs(holder, len(words))

    def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = held[a] * n + held[b]
        at = np.minimum(np.searchsorted(c.pairs, key), max(len(c.pairs) - 1, 0))
        return np.where(c.pairs[at] == key, c.n_tokens + at, size) if len(c.pairs) else np.full(len(key), size)

    several = counted(code[followed])[0]
    several = several[holds.each[several] > 1]
    listed = [np.zeros(0, np.int64)]
    for at, a, b in holds.products(several, several):
        at, a, b = (x[last[b] > first[a]] for x in (at, a, b))
        gram = pair_of(a, b)
        listed.append((several[at] * (size + 1) + gram)[known[gram]])
    # a word that holds a token twice has the pair of it with itself
    twice = np.flatnonzero((last > first) & (holds.each[holder] == 1))
    gram = pair_of(twice, twice)
    listed.append((holder[twice] * (size + 1) + gram)[known[gram]])
    by, grams = np.divmod(counted(np.concatenate(listed))[0], size + 1)
    point(followed, Runs(by, len(words)), code[followed], grams)

    # pairs across a word and the one after it
    both, which = np.unique(code[followed] * len(words) + code[followed + 1], return_inverse=True)
    left, right = np.divmod(both, len(words))
    listed, wide = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for at, a, b in holds.products(left, right):
        gram = pair_of(a, b)
        at, b, gram = (x[known[gram]] for x in (at, b, gram))
        listed.append(at * (size + 1) + gram)
        key = left[at] * n + held[b]
        wide.append(own[np.minimum(np.searchsorted(own, key), len(own) - 1)] != key)
    listed, once = np.unique(np.concatenate(listed), return_index=True)
    by, grams = np.divmod(listed, size + 1)
    point(followed, Runs(by, len(both)), which, grams, np.concatenate(wide)[once])

    cell, here = np.divmod(counted(np.concatenate(hits))[0] if hits else np.zeros(0, np.int64), room)
    return np.r_[0, np.cumsum(np.bincount(cell, minlength=len(kept)))], here


def _batches(schema: pa.Schema, n: int, columns, each: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``n`` rows as batches; ``columns(slice)`` gives the columns of some of them; a row is ``each`` items, 1 if not given."""
    for s in parts(np.ones(n, np.int64) if each is None else each + 1):
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns(s), schema, strict=True)], schema=schema)


@dataclass
class Terms:
    """Texts in chunks, counted anew by each job that needs their terms: counting is cheaper than keeping the counts.

    ``texts``: chunk, the id, ``words`` (the text of tokens and their pairs) and ``chars`` (that of windows; may be the same).
    """

    texts: DataFrame
    id_col: str
    words: str
    chars: str
    with_bias: bool = False
    chunks: int = 1
    parts: int = 1

    @property
    def _names(self) -> tuple[str, str, str]:
        return self.id_col, self.words, self.chars

    def _typed(self, more: str) -> str:
        return f"`{self.id_col}` {self.texts.schema[self.id_col].dataType.simpleString()}, {more}"

    @cached_property
    def _groups(self):
        return self.texts.groupBy("chunk")

    def rows(self) -> DataFrame:
        """One row per (message, kind, gram): id, kind, gram, tf."""
        id_col, names, bias = self.id_col, self._names, self.with_bias

        def run(table: pa.Table) -> pa.Table:
            c = count(table, names, bias)
            schema = pa.schema([(id_col, c.ids.type), ("kind", pa.string()), ("gram", pa.string()), ("tf", pa.int64())])
            return pa.Table.from_batches(_batches(schema, len(c.tf), lambda s: [
                c.ids.take(pa.array(c.message[s])), c.kind(c.gram[s]), c.grams.take(pa.array(c.gram[s])), pa.array(c.tf[s])]), schema)

        return self._groups.applyInArrow(run, self._typed("kind string, gram string, tf long"))

    def counts(self) -> DataFrame:
        """Distinct grams of every chunk: chunk, kind, gram, df, total."""
        id_col, names, bias = self.id_col, self._names, self.with_bias

        def run(key: tuple, table: pa.Table) -> pa.Table:
            c = count(table, names, bias)
            df = np.bincount(c.gram, minlength=len(c.grams))
            total = np.bincount(c.gram, c.tf, len(c.grams)).astype(np.int64)
            there = np.flatnonzero(df)
            schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("gram", pa.string()), ("df", pa.int64()), ("total", pa.int64())])
            return pa.Table.from_batches(_batches(schema, len(there), lambda s: [
                pa.repeat(key[0], len(there[s])), c.kind(there[s]), c.grams.take(pa.array(there[s])), pa.array(df[there[s]]), pa.array(total[there[s]])]), schema)

        return self._groups.applyInArrow(run, "chunk long, kind string, gram string, df long, total long")

    def frequencies(self, least: dict[str, int] | None = None) -> DataFrame:
        """Messages and total count of every gram: kind, gram, df, total; only those in ``least`` messages of their kind, where it names it."""
        names, bias, n, least = self._names, self.with_bias, self.parts, least or {}

        def send(key: tuple, table: pa.Table) -> pa.Table:
            c = count(table, names, bias)
            df = np.bincount(c.gram, minlength=len(c.grams))
            total = np.bincount(c.gram, c.tf, len(c.grams)).astype(np.int64)
            there = np.flatnonzero(df)
            part, blob = packed(c.grams.take(pa.array(there)), c.kinds[there], n, [df[there], total[there]])
            return blobs(part, [key[0].as_py()] * len(part), blob)

        def add(key: tuple, table: pa.Table) -> pa.Table:
            kind = Counted.KINDS[key[0].as_py() % len(Counted.KINDS)].as_py()
            got = [loaded(b) for b in table.column("blob").to_pylist()]
            found = unpacked(got).dictionary_encode()
            of, size = found.indices.to_numpy(), len(found.dictionary)
            df, total = (np.bincount(of, together((x[k] for x in got), np.float64), size).astype(np.int64) for k in (4, 5))  # exact below 2 ** 53
            kept = np.flatnonzero(df >= least.get(kind, 1))
            schema = pa.schema([("kind", pa.string()), ("gram", pa.string()), ("df", pa.int64()), ("total", pa.int64())])
            return pa.Table.from_batches(_batches(schema, len(kept), lambda s: [
                pa.repeat(kind, len(kept[s])), found.dictionary.take(pa.array(kept[s])), pa.array(df[kept[s]]), pa.array(total[kept[s]])]), schema)

        sent = self._groups.applyInArrow(send, _BLOB).repartition(n, "part")
        return sent.groupBy("part").applyInArrow(add, "kind string, gram string, df long, total long")

    def _meeting(self, table: DataFrame, more: tuple, run: Callable, types: str) -> DataFrame:
        """``run(texts, c, x, kept, column)`` of every chunk: its counts, ``x`` of the cells ``kept``, whose gram ``table`` has; ``column(name)`` of these.

        ``table``: kind, gram, idf and the ``more`` columns, all numbers.  Only a chunk's distinct grams travel, to the part of the table
        with the same hashes; the answer is a bit for each and the columns of those found, in the order of the chunk's grams.
        """
        names, bias, n, chunks, numbers = self._names, self.with_bias, self.parts, self.chunks, ("idf", *more)
        kinds = len(Counted.KINDS)

        def ask(key: tuple, texts: pa.Table) -> pa.Table:
            c = cut(texts, *names[1:])
            size = len(c.grams) - (not bias)
            part, blob = packed(c.grams.slice(0, size), c.kinds[:size], n, [])
            return blobs(part, [key[0].as_py()] * len(part), blob)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(held).combine_chunks()
                kind = pc.fill_null(pc.index_in(rows.column("kind"), Counted.KINDS), -1).to_numpy().astype(np.int64)
                rows, kind = rows.filter(pa.array(kind >= 0)).combine_chunks(), kind[kind >= 0]
                if len(rows):
                    columns = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).view(np.float64) for c in numbers]
                    part, blob = packed(rows.column("gram").combine_chunks(), kind, n, columns)
                    yield from blobs(part, [None] * len(part), blob).to_batches()

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += len(batch)
                if size >= PACKED:
                    yield from out(held)
                    held, size = [], 0
            if size:
                yield from out(held)

        def answer(key: tuple, sent: pa.Table) -> pa.Table:
            own = [loaded(b) for b in sent.filter(pc.is_null(sent.column("chunk"))).column("blob").to_pylist()]
            asked = sent.filter(pc.is_valid(sent.column("chunk")))
            columns = [together((x[4 + k].view(np.int64) for x in own), np.int64) for k in range(len(numbers))]  # doubles and longs by their bits
            got = [loaded(b) for b in asked.column("blob").to_pylist()]
            place, ends = found_in(unpacked(got), unpacked(own)), np.cumsum([0, *[len(x[1]) for x in got]]).tolist()
            out = []
            for a, b, x in zip(ends[:-1], ends[1:], got, strict=True):
                there = place[a:b] >= 0
                rows = place[a:b][there]
                out.append(dumped([x[0], np.packbits(there), *[y for c in columns for y in coded(c[rows])]]))
            return blobs([key[0].as_py()] * len(out), asked.column("chunk").to_pylist(), out)

        def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
            c = count(texts, names, bias)
            size = len(c.grams) - (not bias)
            place, held, had, seen = np.full(len(c.grams), -1), [[] for _ in numbers], 0, 0
            hashes, order, found, at = dealt(c.grams.slice(0, size), c.kinds[:size], n)
            spans = dict(zip(found.tolist(), zip(at[:-1].tolist(), at[1:].tolist(), strict=True), strict=True))
            for part, blob in zip(answers.column("part").to_pylist(), answers.column("blob").to_pylist(), strict=True):
                a, b = spans.get(part, (0, 0))
                check, bits, *columns = loaded(blob)
                if check[0] != hashes[order[a:b]].sum() or len(bits) != (b - a + 7) >> 3:
                    raise ValueError("the texts changed between two readings")
                there = order[a:b][np.unpackbits(bits, count=b - a).astype(bool)]
                place[there] = had + np.arange(len(there))
                had, seen = had + len(there), seen + b - a
                for k, m in enumerate(held):
                    m.append(uncoded(*columns[2 * k:2 * k + 2]))
            if seen != size:
                raise ValueError("the texts changed between two readings")
            columns = {m: together(x, np.int64).view(kinds_of[m]) for m, x in zip(numbers, held, strict=True)}
            x, kept = values(c, place, columns["idf"])
            at = place[c.gram[kept]]
            return run(texts, c, x, kept, lambda name, s=slice(None): columns[name][at[s]])

        table = table.select("kind", "gram", F.col("idf").cast("double").alias("idf"), *[F.col(m).cast("long" if dict(table.dtypes)[m] in ("int", "bigint") else "double").alias(m) for m in more])
        kinds_of = {m: np.int64 if t == "bigint" else np.float64 for m, t in table.dtypes}
        sent = self._groups.applyInArrow(ask, _BLOB).union(table.mapInArrow(pack, _BLOB)).repartition(n, "part")
        back = sent.groupBy("part").applyInArrow(answer, _BLOB).repartition(chunks, "chunk")
        return self._groups.cogroup(back.groupBy("chunk")).applyInArrow(meet, types)

    def known(self, table: DataFrame, more: tuple = (), grams: bool = True, top: tuple[str, int, float] | None = None,
              hits: str | None = None) -> DataFrame:
        """Terms that ``table`` (kind, gram, idf and the ``more`` columns) has: id, kind, gram, tf, ``x`` and ``more``.

        ``x`` is the damped count times idf, of length one within each (message, kind); the constant feature's is 1.
        Without ``grams`` the result leaves gram and tf out.
        ``top`` (column w, k, slack) gives of each message and sign of ``x * w`` only the terms whose size is not more than the
        slack below that of the k-th largest: all that may be among the k largest once rounded by less.
        ``hits`` adds the positions of the message's words that a term points at (see ``pointed``): "all", or of each distinct word the
        first ("words"; of an id with several rows all).
        """
        id_col, names, out = self.id_col, self._names, ["kind", *(["gram", "tf"] if grams else []), "x", *more, *(["hits"] if hits else [])]
        numbers = {m: "long" if t in ("int", "bigint") else "double" for m, t in table.select(*more).dtypes}
        types = {"kind": "string", "gram": "string", "tf": "long", "x": "double", "hits": "array<long>"} | numbers

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            own = {m: column(m) for m in more}
            if top is not None and len(kept):
                here = largest(c.message[kept], x * own[top[0]], *top[1:])
                x, kept, own = x[here], kept[here], {m: v[here] for m, v in own.items()}
            columns = {"kind": lambda s: c.kind(c.gram[kept[s]]), "gram": lambda s: c.grams.take(pa.array(c.gram[kept[s]])),
                       "tf": lambda s: pa.array(c.tf[kept[s]]), "x": lambda s: pa.array(x[s])}
            columns |= {m: lambda s, m=m: pa.array(own[m][s]) for m in more}
            each = None
            if hits:
                place = np.full(len(c.grams), -1)
                place[c.gram[kept]] = 0
                ends, at = pointed(texts, names[1], c, kept, place)
                if hits == "words":
                    ends, at = of_distinct_words(texts, names[1], c, kept, ends, at)
                each = np.diff(ends)
                columns["hits"] = lambda s: pa.ListArray.from_arrays(
                    pa.array((ends[s.start:s.stop + 1] - ends[s.start]).astype(np.int32)), pa.array(at[ends[s.start]:ends[s.stop]]))
            kinds = {"kind": pa.string(), "gram": pa.string(), "tf": pa.int64(), "x": pa.float64(), "hits": pa.list_(pa.int64())} | {m: pa.int64() if t == "long" else pa.float64() for m, t in numbers.items()}
            schema = pa.schema([(id_col, c.ids.type), *[(n, kinds[n]) for n in out]])
            return pa.Table.from_batches(_batches(schema, len(kept), lambda s: [
                c.ids.take(pa.array(c.message[kept[s]])), *[columns[n](s) for n in out]], each), schema)

        return self._meeting(table, more, run, self._typed(", ".join(f"{n} {types[n]}" for n in out)))

    def sums(self, table: DataFrame, weight: str) -> DataFrame:
        """id, ``z``: the sum of ``x * weight`` over the terms of every message with a known one."""
        id_col = self.id_col

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            message = c.message[kept]
            z = np.bincount(message, x * column(weight), len(c.ids))
            there = np.flatnonzero(np.bincount(message, minlength=len(c.ids)))
            return pa.table({id_col: c.ids.take(pa.array(there)), "z": pa.array(z[there])})

        return self._meeting(table, (weight,), run, self._typed("z double"))

    def word_scores(self, table: DataFrame, weight: str) -> DataFrame:
        """id, pos, score: ``x * weight`` of every known term shared equally by the positions it points at, added up by position."""
        id_col, names = self.id_col, self._names

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            begin, score, hit = scored(texts, names[1], c, kept, x * column(weight))
            at = np.flatnonzero(hit)
            message = np.searchsorted(begin, at, "right") - 1
            schema = pa.schema([(id_col, c.ids.type), ("pos", pa.int64()), ("score", pa.float64())])
            return pa.Table.from_batches(_batches(schema, len(at), lambda s: [
                c.ids.take(pa.array(message[s])), pa.array(at[s] - begin[message[s]]), pa.array(score[at[s]])]), schema)

        return self._meeting(table, (weight,), run, self._typed("pos long, score double"))

    def word_means(self, table: DataFrame, weight: str) -> DataFrame:
        """id, word, mean: the mean of these scores over the places of every distinct word of a message, 0 where no term points."""
        id_col, names = self.id_col, self._names

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            begin, score, _ = scored(texts, names[1], c, kept, x * column(weight))
            row, code, words = split(texts.column(names[1]))
            at = begin[c.rows[row]] + np.arange(len(row)) - np.searchsorted(row, row, "left")
            key, _, which = numbered(c.rows[row] * max(len(words), 1) + code)
            mean = np.bincount(which, score[at], len(key)) / np.bincount(which, minlength=len(key))
            message, word = np.divmod(key, max(len(words), 1))
            schema = pa.schema([(id_col, c.ids.type), ("word", pa.string()), ("mean", pa.float64())])
            return pa.Table.from_batches(_batches(schema, len(key), lambda s: [
                c.ids.take(pa.array(message[s])), words.take(pa.array(word[s])), pa.array(mean[s])]), schema)

        return self._meeting(table, (weight,), run, self._typed("word string, mean double"))

    def vectors(self, table: DataFrame) -> DataFrame:
        """id, ``at`` (ascending numbers ``idx`` of the message's known terms) and ``x`` of the same places; every message has a row."""
        id_col = self.id_col

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            idx = column("idx")
            order = np.lexsort((idx, c.message[kept]))
            ends = np.r_[0, np.cumsum(np.bincount(c.message[kept], minlength=len(c.ids)))].astype(np.int32)
            return pa.table({id_col: c.ids, "at": pa.ListArray.from_arrays(pa.array(ends), pa.array(idx[order])),
                             "x": pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order]))})

        return self._meeting(table, ("idx",), run, self._typed("at array<long>, x array<double>"))

    def blocks(self, table: DataFrame) -> DataFrame:
        """``ids`` of every chunk's messages, with the cells of its known terms by the numbers ``idx`` of ``table`` (see ``block``)."""

        def run(texts: pa.Table, c: Counted, x: np.ndarray, kept: np.ndarray, column: Callable) -> pa.Table:
            known, found = block(len(c.ids), c.message[kept], column("idx"), x, c.tf[kept], column("idf"), c.kinds[c.gram[kept]])
            return pa.table({"ids": pa.ListArray.from_arrays(pa.array([0, len(c.ids)], pa.int32()), c.ids), "idx": pa.array([known], pa.binary()), "cells": pa.array([found], pa.binary())})

        return self._meeting(table, ("idx",), run, f"ids array<{self.texts.schema[self.id_col].dataType.simpleString()}>, {BLOCK}")


BLOCK = "idx binary, cells binary"


def block(n: int, row: np.ndarray, idx: np.ndarray, x: np.ndarray, tf: np.ndarray | None = None, idf: np.ndarray | None = None, kind: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """The cells of ``n`` rows as the distinct ``idx`` in order, and as ``Cells`` by their places among these.

    With counts, idf and kind of the cells, ``x`` is kept as these and one length for each (row, kind), which are few bytes.
    """
    kinds = 1 if tf is None else len(Counted.KINDS)
    group = row if tf is None else row * kinds + kind
    order = np.lexsort((idx, group))
    group, idx, x = group[order], idx[order], x[order]
    known, first, place = numbered(idx)
    each = np.bincount(group, minlength=n * kinds)
    ahead = place - np.r_[0, place[:-1]] if len(place) else place
    starts = (np.cumsum(each) - each)[each > 0]
    ahead[starts] = place[starts]
    if tf is None:
        parts = [x, np.ones(len(known)), np.ones(n)]
    else:
        tf, idf = tf[order], idf[order]
        raw = (np.log(tf) + 1.0) * idf
        parts = [slim(tf), idf[first], np.sqrt(np.bincount(group, raw * raw, n * kinds))]
    return dumped([slim(np.diff(known, prepend=0))]), dumped([slim(each), slim(ahead), *parts])


def indices(blob: bytes) -> np.ndarray:
    return np.cumsum(loaded(blob)[0].astype(np.int64))


class Cells:
    """Cells of a block in runs, by row and kind: their places, and ``x`` as a value of the cell, a factor of the place and a divisor of the run."""

    def __init__(self, blob: bytes, n: int):
        each, ahead, value, self.factor, length = loaded(blob)
        self.n, self.each = n, each.astype(np.int64)
        upto = np.r_[0, np.cumsum(ahead.astype(np.int64))]
        self.start = np.cumsum(self.each) - self.each
        self.place = upto[1:] - np.repeat(upto[self.start], self.each)
        self.share = np.divide(1.0, length, out=np.zeros(len(length)), where=length > 0)
        self.value = value
        if value.dtype.kind == "u" and len(value):
            most = int(value.max())
            self.value = (np.log(np.arange(1, most + 1)) + 1.0)[value.astype(np.int64) - 1] if most <= len(value) else np.log(value) + 1.0

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Sum of ``x`` times the place's number, by row."""
        out, some = np.zeros(len(self.each)), self.each > 0
        if len(self.place):
            out[some] = np.add.reduceat(self.value * (self.factor * of)[self.place], self.start[some])
        return (out * self.share).reshape(self.n, -1).sum(1)

    def slopes(self, of: np.ndarray) -> np.ndarray:
        """Sum of ``x`` times the row's number, by place."""
        by_run = np.repeat(of, len(self.each) // max(self.n, 1)) * self.share
        return np.bincount(self.place, self.value * np.repeat(by_run, self.each), len(self.factor)) * self.factor


def values(c: Counted, place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` of the cells whose gram has a ``place`` in ``idf`` (-1: none), and those cells."""
    kept = np.flatnonzero(place[c.gram] >= 0)
    if not len(kept):
        return np.zeros(0), kept
    raw = (np.log(c.tf[kept]) + 1.0) * idf[place[c.gram[kept]]]
    kind = c.kinds[c.gram[kept]]
    block = c.message[kept] * 3 + kind
    length = np.sqrt(np.bincount(block, raw * raw))[block]
    x = np.divide(raw, length, out=np.zeros(len(raw)), where=length > 0)
    return np.where(kind == 2, 1.0, x), kept


def scored(table: pa.Table, of_words: str, c: Counted, kept: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each message's positions begin, the sum of shares at every position of all messages, and whether anything points there.

    The ``value`` of a kept cell is shared equally by the positions it points at.
    """
    row, _, _ = split(table.column(of_words))
    size = np.zeros(len(c.ids), np.int64)
    np.maximum.at(size, c.rows, np.bincount(row, minlength=len(c.rows)))
    begin = np.cumsum(size) - size
    place = np.full(len(c.grams), -1)
    place[c.gram[kept]] = 0
    ends, at = pointed(table, of_words, c, kept, place)
    each = np.diff(ends)
    at = np.repeat(begin[c.message[kept]], each) + at
    share = np.repeat(np.divide(value, each, out=np.zeros(len(value)), where=each > 0), each)
    total = int(size.sum())
    return begin, np.bincount(at, share, total), np.bincount(at, minlength=total) > 0


def of_distinct_words(table: pa.Table, of_words: str, c: Counted, kept: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions as ``pointed`` gives them, of equal words of a message that a cell points at only the first; ids with several rows keep all."""
    if not len(at):
        return ends, at
    row, code, words = split(table.column(of_words))
    n_rows, each = np.bincount(c.rows, minlength=len(c.ids)), np.diff(ends)
    first = np.zeros(len(c.ids), np.int64)  # where the message's row begins among all words
    first[c.rows] = np.searchsorted(row, np.arange(len(c.rows)), "left")
    cell = np.repeat(np.arange(len(kept)), each)
    message = c.message[kept][cell]
    single = n_rows[message] == 1
    word = np.where(single, code[np.minimum(first[message] + at, len(code) - 1)], len(words) + at)
    _, once, _ = numbered(cell * (len(words) + int(at.max()) + 1) + word)
    once = np.sort(once)
    return np.r_[0, np.cumsum(np.bincount(cell[once], minlength=len(kept)))], at[once]


def largest(message: np.ndarray, value: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places, in order, whose value's size is at most ``slack`` below the k-th largest of its message and sign."""
    group, size = message * 2 + (value > 0), np.abs(value)
    order = np.lexsort((-size, group))
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    ends = np.r_[first[1:], len(order)]
    least = size[order[np.minimum(first + k, ends) - 1]] - slack
    return np.sort(order[size[order] >= np.repeat(least, ends - first)])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; where it is installed that changes nothing."""
    root, path = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def in_chunks(df: DataFrame, id_col: str, words: str, chars: str, size: Column, with_bias: bool = False) -> Terms:
    """The terms of texts ``words`` (tokens and their pairs) and ``chars`` (windows); ``size`` is the length by which they are dealt."""
    spark = df.sparkSession
    importable(spark)
    total = df.agg(F.sum(size)).first()[0] or 0
    chunks = max(-(-total // CHUNK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST)), 1)
    chunks = int(chunks)
    parts = max(-(-chunks // PER_PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks))
    texts = df.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).alias("chunk"), id_col, *dict.fromkeys((words, chars)))
    return Terms(texts.repartition(chunks, "chunk"), id_col, words, chars, with_bias, chunks, parts)
