"""Fill-in-middle: whole texts cut into prefix, middle and suffix between words, the parts moved behind sentinels.

A text is held as fixed blocks of UTF-8 bytes.  A Fenwick tree over the blocks has the units that end in
each block and the code points that start there; a cut after so many units descends the tree by powers of
two to its block and finds the boundary inside it, so no list of units is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Bytes of a block.
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Blocks:
    """Units and code points of a text, by block.

    A unit is white space and the word behind it, or the white space at the end:
    ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.  It belongs to the block of its last byte.
    """

    def __init__(self, data: bytes, block: int = BLOCK):
        codes = np.frombuffer(data, np.uint8)
        size = -(-len(codes) // block)
        self.block, self.size = block, size
        space = _SPACE[codes]
        self.ends = np.zeros(size * block, bool)
        if len(codes):
            self.ends[:len(codes) - 1] = ~space[:-1] & space[1:]
            self.ends[len(codes) - 1] = True
        self.starts = np.zeros(size * block, bool)
        self.starts[:len(codes)] = (codes & 0xC0) != 0x80
        sums = np.zeros((size + 1, 2), np.int64)
        np.cumsum(self.ends.reshape(size, block).sum(1), out=sums[1:, 0])
        np.cumsum(self.starts.reshape(size, block).sum(1), out=sums[1:, 1])
        at = np.arange(size + 1)
        self.tree = sums - sums[at & (at - 1)]  # node k covers the k & -k blocks up to block k
        self.tree[0] = 0

    def before(self, block: int) -> tuple[int, int]:
        """Units and code points of the first blocks."""
        units = chars = 0
        while block:
            units += int(self.tree[block, 0])
            chars += int(self.tree[block, 1])
            block &= block - 1
        return units, chars

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units == 0:
            return 0, 0
        at = chars = 0
        step = 1 << self.size.bit_length()
        while step:
            if at + step <= self.size and self.tree[at + step, 0] < units:
                at += step
                units -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
            step >>= 1
        first = at * self.block
        end = first + int(np.flatnonzero(self.ends[first:first + self.block])[units - 1]) + 1
        return end, chars + int(self.starts[first:end].sum())


def draws(key: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers from the seed and the key in decimal; a null key counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4))


def transformed(data: bytes, key: int | None, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    blocks = Blocks(data)
    n = blocks.before(blocks.size)[0]
    one, two, chosen, order = draws(key, seed)
    if not data or chosen % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", None, None, data
    low, high = sorted((one % (n + 1), two % (n + 1)))
    (a, before), (b, until) = blocks.cut(low), blocks.cut(high)
    if order % 100 < suffix_first:
        form, parts = "spm", (SUFFIX, data[b:], PREFIX, data[:a], MIDDLE, data[a:b])
    else:
        form, parts = "psm", (PREFIX, data[:a], SUFFIX, data[b:], MIDDLE, data[a:b])
    return n, form, before, until - before, b"".join(parts)


def restored(output: bytes, form: str) -> bytes:
    """The text again.  No part holds a sentinel, and none can arise where a part meets one."""
    if form == "plain":
        return output
    inner = output.index(PREFIX if form == "spm" else SUFFIX, 3)
    last = output.index(MIDDLE, inner + 3)
    one, two, middle = output[3:inner], output[inner + 3:last], output[last + 3:]
    return two + middle + one if form == "spm" else one + middle + two


def transform(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", key: str = "doc_id",
              seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``keep`` columns, n, form, prefix_chars, middle_chars (long, null if plain) and output (string) of every whole text.

    ``rate`` percent of the texts are rearranged, ``suffix_first`` percent of those with the suffix
    first.  Null and empty texts are plain and give an empty output, as do texts that hold a sentinel
    give themselves; a null key draws as an empty one; rows that repeat give repeated rows.
    Other columns are not read.
    """
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            rows = [transformed(t or b"", k, seed, rate, suffix_first) for t, k in zip(texts, batch.column(key).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")] + [T.StructField("output", T.StringType())])
    return docs.select(*dict.fromkeys([*names, key, text])).mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with ``restored`` (string): the text that ``transform`` was given, from its output and form alone."""
    rows = rows.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, output):
            texts = batch.column(output).cast(pa.binary()).to_pylist()
            out = [restored(t or b"", f) for t, f in zip(texts, batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(out, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))
