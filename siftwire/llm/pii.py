"""Personal data by patterns and a skip-chain conditional random field.

Loose patterns find everything that could be an address or a number; these are the nodes of a
document's field.  Neighbours in the text and, at any distance, nodes with the same or similar
letters or digits share potentials.  Loopy message passing carries a label from a plain mention to
a bare or disguised one.  The field learns from what the strict patterns say about a bounded sample;
strict matches themselves always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Belief that a span needs to be added; rounds of message passing; nodes so close (in characters) are neighbours.
SURE, ROUNDS, NEAR = 0.9, 8, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+(]?(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,2}[0-9])++(?![0-9A-Za-z])")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]{1,64}+)++", re.I)
_SIGNS = re.compile(r"[^a-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[list[tuple[int, int]]]:
    """Spans of the strict patterns by kind; matches that fail their test are dropped without another try."""
    if not text or not _ANY.search(text):
        return [[], [], [], []]
    found = [list(emails(text)) if "@" in text else [], [], [], []]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                found[3].append(m.span())
    return found


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, label) in order of start: strict matches with their kind, loose ones beside them with OUTSIDE."""
    nodes = [(s, e, k) for k, spans in enumerate(base) for s, e in spans]
    taken = sorted((s, e) for s, e, _ in nodes)
    loose = [m.span() for m in _NUMBER.finditer(text) if 7 <= sum(map(str.isdigit, m.group())) <= 19]
    if "at" in text or "AT" in text:
        loose += [m.span() for m in _SPELLED.finditer(text)]
    if taken and loose:
        starts, ends = (np.array(x) for x in zip(*taken, strict=True))
        ends = np.maximum.accumulate(ends)
        for s, e in loose:
            k = int(np.searchsorted(starts, e))  # strict spans that begin before this one ends
            if k == 0 or ends[k - 1] <= s:
                nodes.append((s, e, OUTSIDE))
    else:
        nodes += [(s, e, OUTSIDE) for s, e in loose]
    return sorted(nodes)


def keys(kind: int, piece: str) -> list[str]:
    """What makes two mentions the same or similar: bare letters of an address, all or the last seven digits of a number."""
    low = piece.lower()
    if "@" in low or kind == 0 or any(c.isalpha() for c in low):
        low = re.sub(r"[(\[{] ?at ?[)\]}]", "@", low)
        low = re.sub(r"[(\[{] ?dot ?[)\]}]", ".", low)
        return ["a" + _SIGNS.sub("", low)]
    digits = "".join(c for c in low if c.isdigit())
    return ["d" + digits] + (["t" + digits[-7:]] if 7 <= len(digits) <= 15 and low.count(".") < 3 else [])


def features(piece: str) -> list[float]:
    digits = "".join(c for c in piece if "0" <= c <= "9")
    n, letters = len(digits), any(c.isalpha() for c in piece)
    dots = piece.count(".")
    return [1.0, "@" in piece, letters, piece.startswith("+"), "(" in piece, "-" in piece, " " in piece, dots == 3, dots > 3,
            not letters and n < 8, not letters and 8 <= n <= 15, not letters and n >= 16, not letters and n >= 16 and luhn(digits),
            dots == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in piece.split(".")), not letters and n == len(piece)]


@dataclass
class Field:
    """Weights of the node features by label, potentials between neighbours and between similar nodes."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbour pairs, and pairs of consecutive mentions with a key in common: as many edges as mentions, not their pairs."""
    chain = [(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1][0] - nodes[k][1] <= NEAR]
    last: dict[str, int] = {}
    skip = []
    for k, (s, e, label) in enumerate(nodes):
        for key in keys(label, text[s:e]):
            if key in last:
                skip.append((last[key], k))
            last[key] = k
    return chain, list(dict.fromkeys(skip))


def fit(texts: list[str]) -> Field:
    """Weights by gradient steps on what the strict patterns say; potentials from how often linked labels agree."""
    x, y, agree = [], [], {"chain": np.ones((5, 5)), "skip": np.ones((5, 5))}
    for text in texts:
        nodes = candidates(text, base_spans(text)) if text else []
        x += [features(text[s:e]) for s, e, _ in nodes]
        y += [label for *_, label in nodes]
        for name, found in zip(("chain", "skip"), edges(text, nodes) if nodes else ([], []), strict=True):
            for i, j in found:
                a, b = nodes[i][2], nodes[j][2]
                if name == "chain" or (a != OUTSIDE and b != OUTSIDE):
                    agree[name][a, b] += 1
                    agree[name][b, a] += 1
    unary = np.zeros((15, 5))
    if x:
        x, target = np.array(x, float), np.eye(5)[y]
        rate = 4.0 / max(1.0, (x ** 2).sum(1).mean())
        for _ in range(300):
            p = np.exp(x @ unary - (x @ unary).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            unary -= rate * (x.T @ (p - target) / len(x) + 1e-3 * unary)

    def potential(counts: np.ndarray) -> np.ndarray:
        p = counts / counts.sum()
        return np.clip(np.log(p / np.outer(p.sum(0), p.sum(1))), -4, 4)

    # what the strict patterns don't match may still be a mention: its label says nothing about similar ones
    skip = potential(agree["skip"])
    skip[OUTSIDE, :OUTSIDE] = skip[:OUTSIDE, OUTSIDE] = np.minimum(skip[:OUTSIDE, :OUTSIDE].min(), -2)
    skip[:OUTSIDE, :OUTSIDE] += 2 * np.eye(OUTSIDE)
    return Field(unary, potential(agree["chain"]) / 4, skip)


def beliefs(unary: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label beliefs by loopy message passing; ``links`` pairs an (m, 2) array of nodes with their potential."""
    if not any(len(x) for x, _ in links):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    both = np.concatenate([x for x, _ in links])
    m = len(both)
    table = np.concatenate([np.broadcast_to(p, (len(x), 5, 5)) for x, p in links])
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    source, target = np.concatenate([both[:, 0], both[:, 1]]), np.concatenate([both[:, 1], both[:, 0]])
    back = np.concatenate([np.arange(m) + m, np.arange(m)])
    message = np.zeros((2 * m, 5))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, target, message)
        inner = (total[source] - message[back])[:, :, None] + table
        top = inner.max(1, keepdims=True)
        new = np.log(np.exp(inner - top).sum(1)) + top[:, 0]
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    total = unary.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def tagged(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """Strict spans and all spans of each text, as (kind, start, end) by kind and start."""
    bases, all_nodes, x, chain, skip, clamp, first = [], [], [], [], [], [], 0
    for text in texts:
        base = base_spans(text)
        nodes = candidates(text, base) if text and _ANY.search(text) else []
        bases.append(base)
        all_nodes.append(nodes)
        if any(label == OUTSIDE for *_, label in nodes) and any(base):
            near, far = edges(text, nodes)
            chain += [(first + i, first + j) for i, j in near]
            skip += [(first + i, first + j) for i, j in far]
        x += [features(text[s:e]) for s, e, _ in nodes]
        clamp += [label for *_, label in nodes]
        first += len(nodes)
    p = np.zeros((0, 5))
    if x:
        label = np.array(clamp)
        unary = np.array(x, float) @ field.unary
        unary[label != OUTSIDE] += 30 * np.eye(5)[label[label != OUTSIDE]]
        as_pairs = lambda rows: np.array(rows, np.int64).reshape(-1, 2)
        p = beliefs(unary, [(as_pairs(chain), field.chain), (as_pairs(skip), field.skip)])
    out, first = [], 0
    for base, nodes in zip(bases, all_nodes, strict=True):
        strict = [(k, s, e) for k, spans in enumerate(base) for s, e in spans]
        added = []
        for (s, e, label), row in zip(nodes, p[first:first + len(nodes)], strict=True):
            kind = int(row[:OUTSIDE].argmax())
            if label == OUTSIDE and row[kind] >= SURE:
                added.append((kind, s, e))
        first += len(nodes)
        out.append((strict, sorted(strict + added)))
    return out


def learned(docs: DataFrame, limit: int = 2000, longest: int = 20_000) -> Field:
    """The field trained on at most ``limit`` texts of at most ``longest`` characters with a digit or @.

    The least hashes are drawn first, then the texts that have them, so that no task sends more
    texts than are used.
    """
    fit_for = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest)).select(F.xxhash64("text").alias("h"), "text")
    last = fit_for.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    rows = fit_for.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    return fit([r["text"] for r in rows.collect()])


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with base and spans (kind:start:end, comma-joined, by kind and start) and counts of strict matches.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans.
    """
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                found = tagged(part.column("text").to_pylist(), shared.value)
                n = np.array([np.bincount([x[0] for x in strict], minlength=4) if strict else np.zeros(4, np.int64) for strict, _ in found]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(n[:, i].astype(np.int64)) for i in range(4)]
                    + [pa.array([_named(a) for a, _ in found]), pa.array([_named(b) for _, b in found])],
                    names=names + counts + ["base", "spans"])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in counts]
                          + [T.StructField(c, T.StringType()) for c in ("base", "spans")])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents (all columns) with each found span replaced by its kind in brackets; overlapping spans as one."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                texts = part.column("text").to_pylist()
                for row, (_, spans) in enumerate(tagged(texts, shared.value)):
                    if spans:
                        out, done = [], 0
                        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                            if s >= done:
                                out += [texts[row][done:s], f"[{KINDS[kind].upper()}]"]
                            done = max(done, e)
                        texts[row] = "".join(out) + texts[row][done:]
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
