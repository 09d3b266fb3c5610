"""N-gram Jaccard join: a forest of count-vector R-trees.

Shingles are hashed into groups, and the group counts of a set are a point; summed coordinate minima
of two points bound the overlap of their sets from above, and the minima with a box bound it for all
points inside.  One tree over all texts would have to open nearly every box, so each tree holds the
texts that share one of their rarest shingles: two sets as similar as asked share one among the first
few in any common order.  Copies count once, stars around each tree's most typical text are verified
first, and the trees are searched only for pairs that these have not yet connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, buckets, connected, cut, joined, shingles, slices, stored, words

#: Words whose hashes a task remembers; texts are cut into parts of so many rows and bytes, which bounds what a task holds.
REMEMBERED, ROWS, BYTES = 100_000, 500, 2 << 20
#: Counters of the frequency sketch that orders shingles; groups of a count vector; points of a leaf.
SKETCH, GROUPS, LEAF = 1 << 20, 256, 16
#: Groups after neighbouring ones are added up: the first look at a pair of a small tree.
COARSE = 64
#: A count of a vector at its end may be larger, and such a vector rules nothing out.
FULL = 255
#: Texts of one tree that are searched as one block; larger trees are searched block against block.
BLOCK = 4096
#: Groups of a second, finer count vector: with few groups large sets, and near copies, look alike.
WIDE = 1024
#: Trees of so many texts are searched row by row.
SMALL = 48
#: Rounds of stars before what they leave unconnected is searched; each reads the texts again for sets it hasn't met.
STARS = 1


ATTR = np.dtype([("doc", np.int64), ("null", np.bool_), ("node", np.int64), ("n", np.int32), ("typical", np.int32), ("point", np.uint8, GROUPS)])
WIDE_ROW = np.dtype([("node", np.int64), ("wide", np.uint8, WIDE)])
SEED = np.dtype([("seed", np.uint64), ("node", np.int64)])
#: Bits of the filter that tells which sets are in some tree; at worst it lets all of them through.
FILTER_BITS = 26


def parted(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of the batches; what a batch has held goes back to the system before the next one is read."""
    for batch in batches:
        yield from slices(iter([batch]), "text", ROWS * times, BYTES * times)
        del batch
        pa.default_memory_pool().release_unused()


def _sets(column, width: int, seen: WordHashes) -> Iterator[np.ndarray]:
    for text in column.to_pylist():
        s = shingles(seen.of(words(text)), width)
        s.sort()
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def name(s: np.ndarray) -> int:
    """A set's node: a 63-bit hash of its shingles, -1 without any."""
    return int(np.bitwise_xor.reduce((s + np.uint64(len(s))) * (s | np.uint64(1))) >> np.uint64(1)) if len(s) else -1


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often each of SKETCH hash classes of shingles occurs, counted over all texts, in powers of two over the mean.

    Its size is fixed.  A shingle that one text in a thousand holds stands out at any number of texts.
    """
    parts = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = WordHashes(REMEMBERED), np.zeros(SKETCH, np.int64)
        for batch in parted(batches):
            found = np.concatenate([np.zeros(0, np.uint64), *_sets(batch.column("text"), width, seen)])
            np.add.at(total, (found % np.uint64(SKETCH)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in np.split(total, parts)], pa.binary())],
                                         names=["part", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return pd.DataFrame({"part": [group["part"].iat[0]], "counts": [total.tobytes()]})

    rows = (docs.select("text").mapInArrow(run, "part int, counts binary").groupBy("part")
            .applyInPandas(add, "part int, counts binary").collect())
    total = np.zeros(SKETCH, np.int64)
    for r in rows:
        at = r["part"] * (SKETCH // parts)
        total[at:at + SKETCH // parts] = np.frombuffer(r["counts"], np.int64)
    return np.log2(np.maximum(total, 1) / max(total.mean(), 1)).clip(0, 60).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles that a set of n shares one of them with every set at least so similar."""
    return n - -(-n * percent // 100) + 1


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the groups that shingles are hashed into; a count beyond 8 bits stays at their end."""
    return np.minimum(np.bincount(((s >> np.uint64(20)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), FULL)


def seeds(docs: DataFrame, width: int, percent: int, classes: np.ndarray, n_buckets: int) -> DataFrame:
    """(bucket, rows): each document's attributes in bucket -1, finer count vectors in bucket -2, and (shingle, node) of its rarest shingles dealt by shingle.

    Of texts with one set that a task meets, one gives its shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rank, done = WordHashes(REMEMBERED), shared.value, set()
        for part in parted(batches, 4):  # few small pieces a bucket
            out, wide = [], []
            ids = part.column("doc_id").to_pylist()
            attrs = np.zeros(len(part), ATTR)
            for i, s in enumerate(_sets(part.column("text"), width, seen)):
                node = name(s)
                attrs[i]["doc"], attrs[i]["null"], attrs[i]["node"], attrs[i]["n"] = ids[i] or 0, ids[i] is None, node, len(s)
                if not len(s) or ids[i] is None:
                    continue
                level = rank[(s % np.uint64(SKETCH)).astype(np.int64)]
                attrs[i]["typical"], attrs[i]["point"] = level.mean() * 1000, point(s)
                if node not in done:
                    done.add(node)
                    one = np.zeros(1, WIDE_ROW)
                    one["node"], one["wide"] = node, np.minimum(np.bincount(((s >> np.uint64(30)) % np.uint64(WIDE)).astype(np.int64), minlength=WIDE), FULL)
                    wide.append(one)
                    row = np.zeros(prefix_length(len(s), percent), SEED)
                    row["seed"], row["node"] = s[np.argsort(level, kind="stable")[:len(row)]], node
                    out.append(row)
            found = [(-1, attrs.tobytes()), (-2, np.concatenate([np.zeros(0, WIDE_ROW), *wide]).tobytes())]
            if out:
                rows = np.concatenate(out)
                found += [(b, raw) for b, (raw,) in cut([rows], (rows["seed"] % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([raw for _, raw in found], pa.binary())], names=["bucket", "rows"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, rows binary")


def attributes(seeded: DataFrame) -> DataFrame:
    """(doc_id, node, n, typical, point) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                rows = np.frombuffer(raw, ATTR)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc"], mask=rows["null"]), pa.array(rows["node"]), pa.array(rows["n"].astype(np.int64)),
                     pa.array(rows["typical"].astype(np.int64)), pa.array([p.tobytes() for p in rows["point"]], pa.binary())],
                    names=["doc_id", "node", "n", "typical", "point"])

    return seeded.where("bucket = -1").select("rows").mapInArrow(run, "doc_id long, node long, n long, typical long, point binary")


def wide_points(seeded: DataFrame) -> DataFrame:
    """(node, wide) of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                rows = np.frombuffer(raw, WIDE_ROW)
                yield pa.RecordBatch.from_arrays([pa.array(rows["node"]), pa.array([w.tobytes() for w in rows["wide"]], pa.binary())], names=["node", "wide"])

    return seeded.where("bucket = -2").select("rows").mapInArrow(run, "node long, wide binary").groupBy("node").agg(F.first("wide").alias("wide"))


def narrowed(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs that the finer count vectors don't rule out either."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if a is None or b is None:
                    ok.append(True)
                    continue
                p, q = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
                ok.append(bool(p.max() == FULL or q.max() == FULL or np.minimum(p, q).sum() >= need(p.sum(), q.sum(), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.join(wide.toDF("u", "a"), "u", "left").join(wide.toDF("v", "b"), "v", "left")
    return rows.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def trees(seeded: DataFrame) -> DataFrame:
    """(seed, node) of every shingle that at least two sets have among their rarest."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = joined(group["rows"], SEED)
        rows = rows[np.lexsort((rows["node"], rows["seed"]))]
        again = np.concatenate([[False], rows[1:] == rows[:-1]])
        rows = rows[~again]
        same = np.concatenate([[False], rows["seed"][1:] == rows["seed"][:-1]])
        keep = rows[same | np.concatenate([same[1:], [False]])]
        return pd.DataFrame({"seed": keep["seed"].astype(np.int64), "node": keep["node"]})

    return seeded.where("bucket >= 0").groupBy("bucket").applyInPandas(run, "seed long, node long")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the given nodes.

    The nodes set bits of a filter of fixed size that travels with the scan, so that only sets in it
    are moved; a join with the nodes then settles which belong, once each.
    """
    size, mask = 1 << FILTER_BITS, np.uint64((1 << FILTER_BITS) - 1)
    chunk = size // 64

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size, bool)
        for batch in batches:
            on[(batch.column("node").to_numpy().astype(np.uint64) & mask).astype(np.int64)] = True
        packed = np.packbits(on).reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["part", "bits"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [group["part"].iat[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"]]).tobytes()]})

    on = np.zeros(size // 8, np.uint8)
    for r in nodes.select("node").mapInArrow(bits, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        on[r["part"] * chunk // 8:(r["part"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = WordHashes(REMEMBERED), set()
        for part in parted(batches):
            out = []
            for s in _sets(part.column("text"), width, seen):
                node = name(s)
                at = node & (size - 1)
                if node >= 0 and node not in done and shared.value[at >> 3] >> (7 - (at & 7)) & 1:
                    done.add(node)
                    out.append((node, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["node", "shingles"])

    found = docs.select("text").mapInArrow(run, "node long, shingles binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def need(a, b, percent: int):
    """Shingles that two sets of these sizes share at least when they are similar enough."""
    return -(-(a + b) * percent // (100 + percent))


def tree_pairs(q: np.ndarray, qn: np.ndarray, p: np.ndarray, pn: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of q, of p) that the bound can't rule out: an R-tree over p, packed by size and counts."""
    order = np.lexsort((p[:, 1], p[:, 0], pn))
    leaves = [order[k:k + LEAF] for k in range(0, len(order), LEAF)]
    top = np.array([p[x].max(0) for x in leaves], np.int64)
    low, high = np.array([pn[x].min() for x in leaves]), np.array([pn[x].max() for x in leaves])
    for i in range(len(q)):
        n = int(qn[i])
        fit = np.flatnonzero((high * 100 >= n * percent) & (low * percent <= n * 100))
        fit = fit[np.minimum(top[fit], q[i]).sum(1) >= need(n, low[fit], percent)]
        if len(fit):
            at = np.concatenate([leaves[k] for k in fit])
            ok = (np.minimum(p[at], q[i]).sum(1) >= need(n, pn[at], percent)) & (pn[at] * 100 >= n * percent) & (pn[at] * percent <= n * 100)
            if ok.any():
                yield np.full(int(ok.sum()), i), at[ok]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by the sets themselves."""
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(similar, "u long, v long")


def star_pairs(forest: DataFrame, nodes: DataFrame, percent: int, again: bool) -> DataFrame:
    """Distinct (u, v): a centre of each tree with the members that it isn't connected to, where sizes and count vectors allow a link.

    The centre is the most typical set; ``again``: the most typical one beyond that set's component.
    So a round has at most one pair a member, whatever the size of the tree.
    """
    top = F.max(F.struct("typical", "node", "n", "component")).alias("c")
    center = forest.groupBy("seed").agg(top)
    if again:
        center = forest.join(center, "seed").where(F.col("component") != F.col("c.component")).groupBy("seed").agg(top)
    stars = (forest.join(center, "seed").where(F.col("component") != F.col("c.component"))
             .where((F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
             .select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct())
    of = nodes.select("node", "n", "point")
    pairs = stars.join(of.toDF("u", "n", "p"), "u").join(of.toDF("v", "m", "q"), "v")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("p", "q"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            ok = np.minimum(p, q).sum(1, dtype=np.int64) >= need(n, m, percent)
            ok |= (p == FULL).any(1) | (q == FULL).any(1)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok))

    return pairs.select("u", "v", "n", "m", "p", "q").mapInArrow(bounded, "u long, v long")


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, one row per row of ``docs`` (doc_id long, text).

    Null and empty texts, and texts of white space, have no shingles, are linked with nothing and
    stand for themselves.  Copies are linked by having the same set.  Repeated ids give repeated
    rows, and all their texts count as one document's; a null id takes part in no component.
    """
    n_buckets = buckets(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeded = stored(seeds(docs, width, percent, sketch(docs, width), n_buckets), "jaccard-seeds")
    names = stored(attributes(seeded), "jaccard-names")
    known = names.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(known.groupBy("node").agg(F.first("n").alias("n"), F.first("typical").alias("typical"), F.first("point").alias("point"),
                                             F.min("doc_id").alias("first")), "jaccard-nodes")
    forest = trees(seeded).join(nodes.select("node", "n", "typical"), "node")
    forest = stored(forest.select("seed", "node", "n", "typical"), "jaccard-trees")

    # stars first, in trees of every size: they connect a group of copies by as many pairs as it has members
    wide = stored(wide_points(seeded), "jaccard-wide")
    rest = forest.withColumn("component", F.col("node"))
    tried, sets, links = [], None, None

    def checked(pairs: DataFrame) -> None:
        """Adds the links among new pairs; sets move once."""
        nonlocal sets, links
        more = members(pairs)
        for earlier in tried:
            more = more.join(members(earlier), "node", "left_anti")
        found = stored(sets_of(docs, more, width), "jaccard-sets")
        sets = found if sets is None else sets.union(found)
        found = verified(pairs, sets, percent)
        links = stored(found if links is None else links.union(found), "jaccard-links")
        tried.append(pairs)

    for turn in range(STARS):
        pairs = narrowed(star_pairs(rest, nodes, percent, turn > 0), wide, percent)
        for earlier in tried:
            pairs = pairs.join(earlier, ["u", "v"], "left_anti")
        checked(stored(pairs, "jaccard-pairs"))
        near = connected(links, "jaccard-cc")
        rest = forest.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_trees = (rest.groupBy("seed").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
                      .where("x < y").select("seed", "m"))
        rest = stored(rest.join(open_trees, "seed").select(*forest.columns, "component", "m"), "jaccard-open")
    # near copies that are no links are many pairs in a large tree: there the finer vectors rule them out inside the
    # tree; small trees are many, and their few pairs meet the finer vectors one by one
    rest = rest.drop("typical")
    large = rest.where(F.col("m") > SMALL).join(wide.withColumnRenamed("wide", "point"), "node")
    small = rest.where(F.col("m") <= SMALL).join(nodes.select("node", "point"), "node")
    pairs = open_pairs(large, percent, WIDE).union(narrowed(open_pairs(small, percent), wide, percent)).distinct()
    for earlier in tried:
        pairs = pairs.join(earlier, ["u", "v"], "left_anti")
    pairs = stored(pairs, "jaccard-pairs")
    if pairs.take(1):
        checked(pairs)
    # rows that share an id are one document: their sets are linked too
    shared = known.select("doc_id", "node").distinct()
    twice = shared.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("k")).where("k > 1")
    links = links.union(shared.join(twice, "doc_id").select("u", F.col("node").alias("v")))
    near = connected(links, "jaccard-cc")
    nodes = nodes.select("node", "first").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stored(nodes, "jaccard-components")
    top = nodes.groupBy("component").agg(F.min("first").alias("top"))
    of = nodes.join(top, "component").select("node", "top")
    return names.join(of, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"))


def _key(batch: pa.RecordBatch, at: int) -> tuple:
    at %= len(batch)
    return tuple(batch.column(c)[at].as_py() for c in ("seed", "i", "j"))


def _start_of_last(batch: pa.RecordBatch) -> int:
    """Where the last tree of a batch begins."""
    same = np.logical_and.reduce([batch.column(c).to_numpy() == batch.column(c)[-1].as_py() for c in ("seed", "i", "j")])
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def open_pairs(rest: DataFrame, percent: int, width: int = GROUPS) -> DataFrame:
    """Distinct (u, v) of different components in one tree that the count vectors (of this width) can't rule out.

    A tree of many blocks is searched block against block, so no task holds more than two of them.  In a
    small tree the pairs that pass the sums of neighbouring groups are held to the groups themselves.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # each text goes to the block pairs that its own block is part of
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("seed", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component", "point")
    groups = F.pmod(F.xxhash64("seed", "i", "j"), int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            start = _start_of_last(batch)
            held.append(batch.slice(0, start))
            # rows before the batch's last tree are complete once a new tree begins
            if start:
                yield from search(held)
                held = []
            elif len(held) > 1 and _key(held[-2], -1) != _key(batch, 0):
                yield from search(held[:-1])
                held = []
            held.append(batch.slice(start))
        yield from search(held)

    def search(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([x for x in batches if len(x)]) if any(map(len, batches)) else None
        if table is None:
            return
        seed, i, j, own, n, node, of = (table.column(c).to_numpy() for c in ("seed", "i", "j", "own", "n", "node", "component"))
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, width)
        coarse = points.reshape(-1, COARSE, width // COARSE).sum(2, dtype=np.uint16)
        full = (points == FULL).any(1)
        first = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        end = np.append(first[1:], len(seed))
        small = end - first <= SMALL
        found = []
        # small trees: each row against those behind it in its tree, all trees of the batch at once
        last = np.repeat(end, end - first)
        row = np.flatnonzero(np.repeat(small, end - first))
        times = last[row] - row - 1
        for part in np.array_split(np.arange(len(row)), max(1, int(times.sum()) // (6_400_000 // COARSE))):
            a = np.repeat(row[part], times[part])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
            ok = (of[a] != of[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
            a, b = a[ok], b[ok]
            for counted in (coarse, points):
                ok = np.minimum(counted[a], counted[b]).sum(1, dtype=np.int64) >= need(n[a], n[b], percent)
                ok |= full[a] | full[b]
                a, b = a[ok], b[ok]
            found.append((a, b))
        for s, e in zip(first[~small].tolist(), end[~small].tolist(), strict=True):
            wide = points[s:e].astype(np.int64)
            wide[wide == FULL] = 1 << 40  # such counts may be larger and rule nothing out
            left, right = (np.flatnonzero(own[s:e] == x) for x in (i[s], j[s]))
            for x, y in tree_pairs(wide[left], n[s:e][left], wide[right], n[s:e][right], percent):
                a, b = s + left[x], s + right[y]
                ok = (of[a] != of[b]) & ((node[a] < node[b]) | (i[s] != j[s]))
                found.append((a[ok], b[ok]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    dealt = dealt.repartition(groups).sortWithinPartitions("seed", "i", "j")
    return dealt.mapInArrow(run, "u long, v long").distinct()
