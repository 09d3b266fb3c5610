"""Logistic regression whose coefficients never leave their table.

Limited-memory BFGS in the vector-free form: the weights, the gradient and the last steps are columns of
one table by feature, a part of neighbouring features a row.  The driver sees dot products of these columns, turns
them into the few factors of the next step, and the tasks add the columns up.  Margins and gradients are sums
over blocks of rows, which know the numbers of their features; a block and a part exchange arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import deleted, kept_by, written
from . import grams

#: Steps that are remembered; relative gain under which the search ends.
MEMORY, TOLERANCE = 6, 1e-6
#: Step lengths that a round tries, all in one pass over the rows; the first step has no scale yet.
LENGTHS = tuple(2.0 ** k for k in range(-4, 3))
FIRST_LENGTHS = tuple(2.0 ** k for k in range(-6, 16))
#: Features of a part at most.
PART = 1 << 20


def step(dots: np.ndarray, pairs: int) -> np.ndarray:
    """Factors of the basis (steps, changes of the gradient, gradient) that make the next direction."""
    out = np.zeros(2 * pairs + 1)
    out[-1] = -1.0
    alpha = np.zeros(pairs)
    for k in reversed(range(pairs)):
        alpha[k] = out @ dots[:, k] / dots[k, pairs + k]
        out[pairs + k] -= alpha[k]
    if pairs:
        out *= dots[pairs - 1, 2 * pairs - 1] / dots[2 * pairs - 1, 2 * pairs - 1]
    for k in range(pairs):
        beta = out @ dots[:, pairs + k] / dots[k, pairs + k]
        out[k] += alpha[k] - beta
    return out


def _loss(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """ln(1 + exp(z)) - label z, without overflow."""
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - label * z


def blocks_of(features: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, x) rows as blocks, rows of one id together."""
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column(id_col).combine_chunks().dictionary_encode(null_encoding="encode")
        row, idx = ids.indices.to_numpy().astype(np.int64), table.column("idx").to_numpy().astype(np.int64)
        known, found = grams.block(len(ids.dictionary), row, idx, table.column("x").to_numpy().astype(np.float64))
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array([0, len(ids.dictionary)], pa.int32()), ids.dictionary), "idx": pa.array([known], pa.binary()), "cells": pa.array([found], pa.binary())})

    kind = features.schema[id_col].dataType.simpleString()
    return features.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_b"), id_col, "idx", "x").groupBy("_b").applyInArrow(run, f"ids array<{kind}>, {grams.BLOCK}")


def fit(features: DataFrame, labels: DataFrame, work_dir: str, id_col: str = "msg_id", c: float = 10.0,
        max_iter: int = 100, memory: int = MEMORY, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(idx, w) of every feature, and the bias; ``features``: id, idx, x, without the constant one."""
    size = (features.agg(F.max("idx")).first()[0] or 0) + 1
    found, bias = fit_blocks(blocks_of(features, id_col), labels, size, work_dir, id_col, c, max_iter, memory, tolerance)
    return found.join(features.select("idx").distinct(), "idx", "left_semi"), bias


#: A number of a block or of a part of the features (-1: the constant one), and arrays.
_SENT = "chunk long, part long, blob binary"
_STATE = "part long, w binary, g binary, s binary, y binary, dots array<double>"


def _sent(rows: list[tuple]) -> pa.Table:
    chunk, part, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array(part, pa.int64()), "blob": pa.array(blob, pa.binary())})


def _state(part: int, w: np.ndarray, g: np.ndarray, s: np.ndarray, y: np.ndarray) -> pa.Table:
    """A part's columns, and their dot products in the order steps, changes, gradient, weights."""
    basis = np.vstack([s, y, g[None], w[None]]).astype(np.float64)
    return pa.table({"part": [part], "w": pa.array([w.tobytes()], pa.binary()), "g": pa.array([g.tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary()),
                     "y": pa.array([y.tobytes()], pa.binary()), "dots": pa.array([(basis @ basis.T).ravel().tolist()], pa.list_(pa.float64()))})


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w, g = (np.frombuffer(row[k], np.float64) for k in "wg")
    s, y = (np.frombuffer(row[k], np.float32).reshape(-1, len(w)) for k in "sy")
    return w, g, s, y


def fit_blocks(blocks: DataFrame, labels: DataFrame, size: int, work_dir: str, id_col: str = "msg_id", c: float = 10.0,
               max_iter: int = 100, memory: int = MEMORY, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(idx, w) of the ``size`` features, and the bias.

    ``blocks``: ids, idx, cells, as ``grams.block`` makes them, without the constant feature; ``labels``: id, label (0 or 1), weight.  The
    penalty 1 / (c * total weight) covers the bias too.  The features' columns lie by parts of neighbouring numbers, the rows by
    blocks, both bucketed on shared storage.  A round sends each block the direction at its own features, and each
    part the slopes of every block; both are arrays.  Every round is written to ``work_dir``, and the one before is deleted.
    Steps and changes are kept in 32 bits: products are taken of what is kept.  The
    constant feature would be one key with every row: it is a number beside the tables instead.
    """
    spark = labels.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = max(-(-size // max(n, -(-size // PART))), 1)
    parts = -(-size // span)
    grams.importable(spark)
    found = written(blocks.withColumn("chunk", F.monotonically_increasing_id()), f"{work_dir}/blocks")
    truth = labels.select(id_col, F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"))
    total = truth.agg(F.sum("weight")).first()[0]
    penalty = 1.0 / (c * total)
    # a row without any feature still counts with the constant one; those make up a block of their own
    members = found.select("chunk", F.posexplode("ids").alias("pos", id_col))
    rows = members.join(truth, id_col, "full").groupBy(F.coalesce("chunk", F.lit(-1)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("r"))
    rows = rows.join(found.select("chunk", "idx", "cells"), "chunk", "left").select("chunk", "idx", "cells", F.col("r.y").alias("y"), F.col("r.weight").alias("weight"))
    data = kept_by(rows, "chunk", f"{work_dir}/by-chunk")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("idx").to_pylist(), strict=True):
                idx = grams.indices(blob)
                at = np.searchsorted(idx, np.arange(parts + 1) * span)
                yield from _sent([(chunk, k, grams.dumped([grams.slim(np.diff(idx[a:b], prepend=k * span))]))
                                  for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]).to_batches()

    asks = kept_by(data.where("idx IS NOT NULL").select("chunk", "idx").mapInArrow(wanted, _SENT), "part", f"{work_dir}/by-part")

    def first(table: pa.Table) -> dict:
        """The block's row, its lists as arrays."""
        row = {k: table.column(k)[0] for k in ("chunk", "idx", "cells", "y", "weight")}
        return {k: v.values.to_numpy() if k in ("y", "weight") else v.as_py() for k, v in row.items()}

    def sloped(t: float) -> Callable:
        """Slopes of the loss by feature at ``t`` steps along, sent to their parts, and over the constant feature."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = first(left)
            y, weight = row["y"], row["weight"]
            z = sum((np.frombuffer(b, np.float64) * (1.0 if k == -1 else t) for k, b in zip(right.column("part").to_pylist(), right.column("blob").to_pylist(), strict=True)), np.zeros(len(y)))
            r = (1.0 / (1.0 + np.exp(-z)) - y) * weight / total
            out = [(row["chunk"], -1, r.sum(keepdims=True).tobytes())]
            if row["idx"] is not None:
                idx = grams.indices(row["idx"])
                slope = grams.Cells(row["cells"], len(y)).slopes(r)
                at = np.searchsorted(idx, np.arange(parts + 1) * span)
                out += [(row["chunk"], k, grams.dumped([grams.slim(idx[a:b] - k * span), slope[a:b]])) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]
            return _sent(out)

        return run

    def moved(t: float, factors: list[float], keep: list[int]) -> Callable:
        """A part's columns after ``t`` steps along the direction of ``factors``, with the slopes there."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:  # the constant feature
                total_ = sum(np.frombuffer(b, np.float64)[0] for b in right.column("blob").to_pylist())
                return pa.table({"part": [-1], **{k: pa.array([None], pa.binary()) for k in "wgsy"}, "dots": pa.array([[total_]], pa.list_(pa.float64()))})
            row = left.to_pylist()[0]
            w, g, s, y = _loaded(row)
            slope = np.zeros(len(w))
            for idx, value in map(grams.loaded, right.column("blob").to_pylist()):
                slope[idx] += value
            if not factors:
                return _state(row["part"], w, slope, s, y)
            ahead = t * (np.array(factors) @ np.vstack([s, y, g[None]]).astype(np.float64))
            w = w + ahead
            new = slope + penalty * w
            s, y = np.vstack([s[keep], ahead[None].astype(np.float32)]), np.vstack([y[keep], (new - g)[None].astype(np.float32)])
            return _state(row["part"], w, new, s, y)

        return run

    def along(factors: list[float]) -> Callable:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return _sent([])
            _, g, s, y = _loaded(right.to_pylist()[0])
            d = np.array(factors) @ np.vstack([s, y, g[None]]).astype(np.float64)
            return _sent([(chunk, part, d[grams.indices(blob)].tobytes()) for chunk, part, blob in zip(*(left.column(k).to_pylist() for k in ("chunk", "part", "blob")), strict=True)])

        return run

    def tried(lengths: tuple[float, ...], at_bias: float, t: float) -> Callable:
        """Margins ``z`` after the last ``t`` steps, their change ``u`` along the direction, and the loss at every length."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = first(left)
            y, weight = row["y"], row["weight"]
            z, pieces = np.zeros(len(y)), {}
            for k, b in zip(right.column("part").to_pylist(), right.column("blob").to_pylist(), strict=True):
                b = np.frombuffer(b, np.float64)
                if k < 0:
                    z = z + (b if k == -1 else t * b)
                else:
                    pieces[k] = b
            u = np.full(len(y), at_bias)
            if row["idx"] is not None:
                u += grams.Cells(row["cells"], len(y)).sums(np.concatenate([np.zeros(0), *[pieces[k] for k in sorted(pieces)]]))
            return _sent([(row["chunk"], -1, z.tobytes()), (row["chunk"], -2, u.tobytes()), (row["chunk"], -3, np.array([(weight * _loss(z + v * u, y)).sum() / total for v in lengths]).tobytes())])

        return run

    def ends(part: int) -> int:
        return min(span, size - part * span)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                nothing = np.zeros((0, ends(part)), np.float32)
                yield from _state(part, np.zeros(ends(part)), np.zeros(ends(part)), nothing, nothing).to_batches()

    def next_state(turn: int, margins: DataFrame, t: float, factors: list[float], keep: list[int]) -> tuple[DataFrame, np.ndarray, float]:
        sent = data.groupBy("chunk").cogroup(margins.where("part IN (-1, -2)").groupBy("chunk")).applyInArrow(sloped(t), _SENT)
        new = kept_by(state.where("part >= 0").groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(moved(t, factors, keep), _STATE), "part", f"{work_dir}/state-{turn}")
        got = {r.part: r.dots for r in new.select("part", "dots").collect()}
        at_slope = got.pop(-1)[0]
        return new, np.sum([np.array(d) for d in got.values()], axis=0), at_slope

    def gone(name: str) -> None:
        deleted(spark, f"{work_dir}/{name}")

    state = kept_by(spark.range(parts).mapInArrow(start, _STATE), "part", f"{work_dir}/state-begin")
    margin = spark.createDataFrame([], _SENT)
    state, products, at_bias = next_state(0, margin, 0.0, [], [])
    gone("state-begin")
    bias = {"w": 0.0, "g": at_bias}
    pairs, t = 0, 0.0
    for turn in range(1, max_iter + 1):
        basis = [f"s{k}" for k in range(pairs)] + [f"y{k}" for k in range(pairs)] + ["g"]
        names = [*basis, "w"]
        own = np.array([bias[x] for x in names])
        dots = products.reshape(len(names), len(names)) + np.outer(own, own)
        if dots[-2, -2] == 0:
            break
        factors = step(dots[:-1, :-1], pairs)
        at_bias = float(factors @ own[:-1])
        squares = dots[-1, -1], float(factors @ dots[-1, :-1]), float(factors @ dots[:-1, :-1] @ factors)
        lengths = (0.0, *(LENGTHS if pairs else FIRST_LENGTHS))
        sent = asks.groupBy("part").cogroup(state.where("part >= 0").groupBy("part")).applyInArrow(along(factors.tolist()), _SENT)
        sent = sent.union(margin.where("part IN (-1, -2)"))
        new = written(data.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(tried(lengths, at_bias, t), _SENT), f"{work_dir}/moving-{turn}")
        if turn > 1:
            gone(f"moving-{turn - 1}")
        margin = new
        losses = np.sum([np.frombuffer(r.blob, np.float64) for r in margin.where("part = -3").select("blob").collect()], axis=0)
        values = [v + penalty / 2 * (squares[0] + 2 * k * squares[1] + k * k * squares[2]) for v, k in zip(losses, lengths, strict=True)]
        best = min(range(len(lengths)), key=values.__getitem__)
        if best == 0:
            break
        t = lengths[best]
        keep = list(range(1, pairs) if pairs == memory else range(pairs))
        state, products, at_slope = next_state(turn, margin, t, factors.tolist(), keep)
        gone(f"state-{turn - 1}")
        m = len(keep)
        now = {"w": bias["w"] + t * at_bias, f"s{m}": t * at_bias}
        now["g"] = at_slope + penalty * now["w"]
        bias = now | {f"{kind}{j}": bias[f"{kind}{k}"] for kind in "sy" for j, k in enumerate(keep)} | {f"y{m}": now["g"] - bias["g"]}
        pairs = m + 1
        if values[0] - values[best] <= tolerance * max(abs(values[0]), abs(values[best])):
            break

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in zip(batch.column("part").to_pylist(), batch.column("w").to_pylist(), strict=True):
                w = np.frombuffer(w, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(part * span + np.arange(len(w))), pa.array(w)], names=["idx", "w"])

    return state.where("part >= 0").select("part", "w").mapInArrow(listed, "idx long, w double"), float(bias["w"])
