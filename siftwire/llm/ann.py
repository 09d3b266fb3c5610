"""Nearest neighbours by inner product: lists with an adaptive scan of dimensions.

A further coordinate turns the largest inner product into the smallest distance; a random rotation
then spreads every vector evenly over its coordinates.  Within a list, distances grow block of
columns by block of columns, and after each block a test on the partial distance gives up the
candidates that are unlikely to come within the query's bound.  What is left gets its exact product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the lists are fitted on, and rows of a list, on average; most lists.
SAMPLE, PER_LIST, LISTS = 8192, 1000, 1024
#: Share of true neighbours that the probed lists hold in the sample; columns of a block; strictness of the test.
TARGET, COLUMNS, STRICT = 0.97, 16, 2.1
#: Members and queries of one task's group.
MEMBERS, QUERIES = 20_000, 4_000


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, one row an id, and their length.

    Null, zero and non-finite vectors and null ids are left out, and vectors of any but the most
    frequent length.  Of rows that repeat an id, the least vector counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(v, x -> x <> 0)")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 0
    return rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")), d


@dataclass
class Lists:
    """Rotation, square of the largest norm, centres, lists to probe, and the sample in rotated form."""

    rotation: np.ndarray
    top: float
    centres: np.ndarray
    probe: int
    ids: np.ndarray
    sample: np.ndarray

    def rotated(self, v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.top - (v ** 2).sum(1), 0))
        return np.hstack([v, more[:, None]]) @ self.rotation

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        return (x ** 2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres ** 2).sum(1)


def centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (-2 * x @ c.T + (c ** 2).sum(1)).argmin(1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def fit(rows: DataFrame, d: int, k: int) -> Lists:
    """Lists from at most SAMPLE rows, drawn by the hash of their id.

    As many lists are probed as hold TARGET of the k nearest sample rows of some sample rows,
    measured by brute force.
    """
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    # ids first, then the vectors of the drawn ones, so that no task sends more vectors than are used
    last = rows.select(F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    drawn = rows.where(F.xxhash64("vec_id") <= F.lit(last).cast("long")).orderBy(F.xxhash64("vec_id")).collect()
    ids, v = np.array([r["vec_id"] for r in drawn], np.int64), np.array([r["v"] for r in drawn]).reshape(-1, d)
    rotation, _ = np.linalg.qr(np.random.default_rng(17).normal(size=(d + 1, d + 1)))
    out = Lists(rotation, top or 0.0, np.zeros((1, d + 1)), 1, ids, v)
    x = out.rotated(v, False)
    out.centres = centres(x, max(1, min(LISTS, n // PER_LIST, len(x) // 8)))
    own = out.nearest(x).argmin(1)
    some = v[:256]
    score = some @ v.T
    score[np.arange(len(some)), np.arange(len(some))] = -np.inf
    best = np.argsort(-score, axis=1)[:, :min(k, len(v) - 1)]
    order = out.nearest(out.rotated(some, True)).argsort(1).argsort(1)  # rank of each list
    ranks = np.sort(np.take_along_axis(order, own[best], 1).ravel())
    out.probe = int(ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))]) + 1 if len(ranks) else 1
    return out


def _matrix(column, d: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()].reshape(-1, d)


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, candidate) that no test gave up; ``bound`` is each query's squared distance to beat."""
    d = x.shape[1]
    first = min(d, 2 * COLUMNS)
    part = (q[:, :first] ** 2).sum(1)[:, None] - 2 * q[:, :first] @ x[:, :first].T + (x[:, :first] ** 2).sum(1)
    allowed = bound[:, None] * min(1.0, first / d * (1 + STRICT / np.sqrt(first)) ** 2)
    i, j = np.nonzero(part <= allowed * (1 + 1e-9))
    dist = part[i, j]
    for start in range(first, d, COLUMNS):
        end = min(d, start + COLUMNS)
        dist = dist + ((q[i, start:end] - x[j, start:end]) ** 2).sum(1)
        share = 1.0 if end == d else min(1.0, end / d * (1 + STRICT / np.sqrt(end)) ** 2)
        keep = dist <= bound[i] * share * (1 + 1e-9) + 1e-12
        i, j, dist = i[keep], j[keep], dist[keep]
    return i, j


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    start = np.searchsorted(q, q)
    return order[np.arange(len(q)) - start < k]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, itself left out.

    ``is_query`` is a condition on vec_id.  A query gets k rows, or all others if there are fewer.
    """
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], schema)
    model = fit(rows, d, k)
    shared = spark.sparkContext.broadcast(model)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            v = _matrix(batch.column("v"), d)
            own = m.nearest(m.rotated(v, False)).argmin(1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary())],
                                             names=["list", "vec_id", "raw"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        everything = m.rotated(m.sample, False)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                v, ids = _matrix(part.column("v"), d), part.column("vec_id").to_numpy()
                x = m.rotated(v, True)
                # the k-th nearest of the sample bounds the search, and its rows are answers already
                dist = (x ** 2).sum(1)[:, None] - 2 * x @ everything.T + (everything ** 2).sum(1)
                dist[ids[:, None] == m.ids[None, :]] = np.inf
                near = np.argsort(dist, axis=1, kind="stable")[:, :k]
                last = np.take_along_axis(dist, near, 1)[:, -1] if near.shape[1] == k else np.full(len(v), np.inf)
                lists = m.nearest(x).argsort(1)[:, :m.probe]
                first = [[(int(m.ids[j]), float(v[i] @ m.sample[j])) for j in near[i] if np.isfinite(dist[i, j])] for i in range(len(v))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(np.maximum(last, 0)),
                     pa.array(lists.tolist(), pa.list_(pa.int32())),
                     pa.array([[{"vec_id": a, "score": b} for a, b in f] for f in first], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))],
                    names=["query_id", "raw", "bound", "lists", "found"])

    members = rows.mapInArrow(deal, "list int, vec_id long, raw binary")
    asked = rows.where(is_query).mapInArrow(ask, "query_id long, raw binary, bound double, lists array<int>, found array<struct<vec_id:long,score:double>>")
    probes = asked.select(F.explode("lists").alias("list"), "query_id", "raw", "bound")
    # a long list and many queries of one list are cut into blocks, so that no group grows with the data
    sizes = members.groupBy("list").agg(F.count("*").alias("m")).join(probes.groupBy("list").agg(F.count("*").alias("q")), "list").select(
        "list", F.ceil(F.col("m") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qb"))
    sizes = F.broadcast(sizes)  # at most LISTS rows
    members = (members.join(sizes, "list").withColumn("i", F.pmod(F.xxhash64("vec_id"), "mb").cast("int"))
               .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("list", "i", "j", "vec_id", "raw"))
    probes = (probes.join(sizes, "list").withColumn("j", F.pmod(F.xxhash64("query_id"), "qb").cast("int"))
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select("list", "i", "j", "query_id", "raw", "bound"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, out = shared.value, []
        if len(left) and len(right):
            v = np.frombuffer(b"".join(left["raw"]), np.float64).reshape(-1, d)
            vec, x = left["vec_id"].to_numpy(), m.rotated(v, False)
            for at in range(0, len(right), 500):
                part = right.iloc[at:at + 500]
                w, query = np.frombuffer(b"".join(part["raw"]), np.float64).reshape(-1, d), part["query_id"].to_numpy()
                i, j = scan(m.rotated(w, True), part["bound"].to_numpy(), x)
                keep = query[i] != vec[j]
                i, j = i[keep], j[keep]
                score = np.einsum("ij,ij->i", w[i], v[j])
                top = best_of(query[i], vec[j], score, k)
                out.append(pd.DataFrame({"query_id": query[i[top]], "vec_id": vec[j[top]], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = (members.groupBy("list", "i", "j").cogroup(probes.groupBy("list", "i", "j")).applyInPandas(meet, "query_id long, vec_id long, score double")
             .union(asked.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
