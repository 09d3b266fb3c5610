"""Which of the rules' needles a text holds: numpy over Arrow arrays, so that a text is read once and not once a needle.

Needles and texts are compared byte by byte, as ``contains`` does.  Places whose first three bytes begin no needle are
ruled out for a whole slice of texts at once; what is left is compared needle by needle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import rules as r
from . import rx

#: The needles of everything that rules and signals look for in a message; a needle's place is its bit.
NEEDLES = tuple(sorted({w for p in r.PATTERNS for w in rx.needles(p)}))
PLACE = {w: k for k, w in enumerate(NEEDLES)}
#: Bytes of text that are looked through at once, if they are several texts.
SLICE = 1 << 20


def finder(needles: tuple[str, ...]):
    """Function from an array of texts to one of their needles' bits, 64 to a number; null for null."""
    words = [np.frombuffer(w.encode(), np.uint8) for w in needles]
    wide = -(-len(words) // 64)
    by_size = {n: [(k, w) for k, w in enumerate(words) if min(len(w), 3) == n] for n in (1, 2, 3)}

    def code(b: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` bytes from each place on as a number."""
        out = b[:len(b) - n + 1].astype(np.uint32)
        for j in range(1, n):
            out |= b[j:len(b) - n + 1 + j].astype(np.uint32) << np.uint32(8 * j)
        return out

    def mixed(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(16)

    heads = {n: [int(code(w[:n], n)[0]) for _, w in of] for n, of in by_size.items()}
    begins = {n: np.zeros(1 << 16, bool) for n in by_size}
    for n, found in heads.items():
        begins[n][mixed(np.array(found, np.uint32))] = True

    def present(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits by text; the texts lie one after the other in ``b``."""
        held = np.zeros((len(ends), wide * 64), bool)
        for n, of in by_size.items():
            if not of or len(b) < n:
                continue
            codes = code(b, n)
            at = np.flatnonzero(begins[n][mixed(codes)])
            at = at[np.argsort(codes[at], kind="stable")]
            row, codes = np.searchsorted(ends, at, "right"), codes[at]
            low, high = (np.searchsorted(codes, np.array(heads[n], np.uint32), side) for side in ("left", "right"))
            for (k, w), x, y in zip(of, low.tolist(), high.tolist(), strict=True):
                if x == y:
                    continue
                inside = at[x:y] + len(w) <= ends[row[x:y]]
                place, mine = at[x:y][inside], row[x:y][inside]
                for j in range(n, len(w)):
                    if not len(place):
                        break
                    same = b[place + j] == w[j]
                    place, mine = place[same], mine[same]
                held[mine, k] = True
        return np.packbits(held, axis=1, bitorder="little").view(np.int64)

    def find(texts: pa.Array) -> pa.Array:
        nulls = texts.is_null()
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        bits, start = [np.zeros((0, wide), np.int64)], 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, "right")) - 1)
            bits.append(present(b[ends[start]:ends[stop]], ends[start + 1:stop + 1] - ends[start]))
            start = stop
        size = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * wide)
        return pa.ListArray.from_arrays(size, pa.array(np.concatenate(bits).ravel()), mask=nulls)

    return find


def needles_in(folded: Column) -> Column:
    """``array<bigint>`` of the needles that the folded text holds."""
    find = finder(NEEDLES)

    def run(texts: pa.Array) -> pa.Array:
        return find(texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(folded)


def any_of(column: str, words) -> str | None:
    """SQL text: whether any of the words is among the needles in ``column``; None if not all of them are needles."""
    if any(w not in PLACE for w in words):
        return None
    masks: dict[int, int] = {}
    for w in words:
        masks[PLACE[w] // 64] = masks.get(PLACE[w] // 64, 0) | 1 << PLACE[w] % 64
    signed = {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}
    return "(" + " OR ".join(f"(`{column}`[{k}] & {_number(m)}) <> 0L" for k, m in sorted(signed.items())) + ")"


def _number(x: int) -> str:
    return f"({x + 1}L - 1L)" if x == -(1 << 63) else f"{x}L"
