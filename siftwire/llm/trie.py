"""Conversation prefix trie by truncation peeling.

A conversation is the path of its turns, each known by the digest of all turns up to it.  Paths are
dealt in sorted order, so the conversations below a node lie side by side.  Within a block of
neighbours the nodes are peeled from the deepest level up: at each depth the conversations that end
there join the survivors of the level below, the last turn is stripped, and what then starts alike is
one node with its children's sums.  Only nodes on a block's first and last path can reach into the next
block; these two paths go on, with what was summed for them, into another round over fewer rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a block and the fewest paths in it; ids of a span that are gathered into one row; nodes that may be broadcast.
BLOCK, FEWEST, SPAN, BROADCAST = 20_000, 4, 4096, 1_000_000
#: Head conversations serve groups of so many ids with fewer turns than this.
GROUP, HEADS = 100, 6

DIGEST = 16
_NONE = np.iinfo(np.int64).max
#: Sums kept for a node: conversations, their least id, children, leaves, saved, conversations that end in it.
N, LEAST, CHILDREN, LEAVES, SAVED, ENDED = range(6)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): every turn's place from 1, digest of role and text, and code points of its text.

    Turns are ordered by ``turn``, null first; those that tie, by digest.  Null roles and texts are
    empty; rows without a conv_id belong to no conversation; rows that repeat are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.length(text).alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", place.cast("long").alias("pos"), "digest", "chars")


def rebuilt(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, part, pos, digest, chars): each conversation c with the first h turns of c - c % group for its own.

    h is crc32 of c in decimal modulo ``heads``.  Part 0 has one row of every conversation, without a
    turn; part 1 the given turns, fewer or none if that conversation has no more; part 2 its own after h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = rows.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    shared = rows.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    given = first.where("h > 0").join(shared, "base").where("pos <= h")
    mark = first.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("chars"))
    return (mark.union(given.select("conv_id", F.lit(1), "pos", "digest", "chars"))
            .union(rows.where(F.col("pos") > h).select("conv_id", F.lit(2), "pos", "digest", "chars")))


_PATH = "conv_id long, path binary, chars binary, sums binary"


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, chars, sums): of each conversation, the digests of its first 1, 2, .. turns in a row.

    A task walks its conversations in order and holds one at a time, in 20 bytes a turn.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path, chars, last = None, bytearray(), [], b""
        done: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            ids, ways, sizes = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ways, pa.binary()), pa.array(sizes, pa.binary()),
                                               pa.nulls(len(ids), pa.binary())], names=["conv_id", "path", "chars", "sums"])

        for batch in batches:
            for c, digest, size in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "chars")), strict=True):
                if c != conv:
                    if conv is not None:
                        done.append((conv, bytes(path), np.array(chars, np.int32).tobytes()))
                        held += len(path)
                    if held > 4 << 20 or len(done) >= 10_000:
                        yield out()
                        done, held = [], 0
                    conv, path, chars, last = c, bytearray(), [], b""
                if digest is not None:
                    last = hashlib.md5(last + digest).digest()
                    path += last
                    chars.append(size)
        if conv is not None:
            done.append((conv, bytes(path), np.array(chars, np.int32).tobytes()))
            yield out()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.select("conv_id", "digest", "chars").mapInArrow(run, _PATH)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many first turns two paths share."""
    m = min(len(a), len(b))
    other = np.flatnonzero((a[:m] != b[:m]).any(1))
    return int(other[0]) if len(other) else m


_NODE = ["open", "path", "chars", "sums", "key", "parent", "parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
_NODE_TYPES = [pa.bool_(), *[pa.binary()] * 5, *[pa.int64()] * 7, pa.bool_()]
_NODE_SCHEMA = ("open boolean, path binary, chars binary, sums binary, key binary, parent binary, parent_conv_id long, conv_id long, depth long, "
                "n_convs long, n_children long, n_leaves long, saved_tokens long, ended boolean")


def _digests(keys: np.ndarray, root: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as binary; the root's key is empty."""
    found = pa.Array.from_buffers(pa.binary(DIGEST), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
    return pc.if_else(pa.array(root), pa.scalar(b"", pa.binary()), found)


def peeled(rows: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted neighbours (conv_id, path, chars, sums); ``last``: there are no others, so no node stays open.

    A path whose ``sums`` is null is a conversation that ends at its end; else it carries sums of its nodes.
    """
    count = len(rows)
    ways = [np.frombuffer(r[1], np.uint64).reshape(-1, 2) for r in rows]
    length = np.array([len(w) for w in ways])
    at = np.concatenate([[0], np.cumsum(length + 1)])
    sums = np.zeros((6, at[-1]), np.int64)
    sums[LEAST] = _NONE
    key = np.zeros((at[-1], 2), np.uint64)
    chars = np.zeros(at[-1], np.int64)
    for k, (conv, _, sizes, known) in enumerate(rows):
        a, b = at[k], at[k + 1]
        key[a + 1:b] = ways[k]
        chars[a + 1:b] = np.frombuffer(sizes, np.int32)
        if known is None:
            sums[[N, LEAST, ENDED], b - 1] = 1, conv, 1
        else:
            sums[:, a:b] = np.frombuffer(known, np.int64).reshape(6, -1)
    alike = np.array([-1] + [_shared(ways[k - 1], ways[k]) for k in range(1, count)])
    left = np.zeros_like(sums)  # what the open nodes of the first and the last path go on with
    left[LEAST] = _NONE
    child = np.zeros(0, np.int64)  # first row of each closed node one level below, and its sums
    below = np.zeros((6, 0), np.int64)
    waiting = None  # its columns but for the parent's id
    for depth in range(int(length.max()), -1, -1):
        alive = np.flatnonzero(length >= depth)
        start = np.flatnonzero(alike[alive] < depth)
        first = alive[start]
        cell = at[alive] + depth
        node = np.add.reduceat(sums[:, cell], start, axis=1)
        node[LEAST] = np.minimum.reduceat(sums[LEAST, cell], start)
        up = np.searchsorted(first, child, "right") - 1
        for k in (N, LEAVES, SAVED):
            np.add.at(node[k], up, below[k])
        np.add.at(node[CHILDREN], up, 1)
        np.minimum.at(node[LEAST], up, below[LEAST])
        closed = np.ones(len(first), bool)
        if not last:
            closed[0] &= bool(first[0])  # the first row's node, where that row is so long
            closed[-1] &= length[-1] < depth
        if waiting is not None:
            known = closed[up]
            waiting[6] = pa.array(node[LEAST, up], mask=~known)
            yield pa.RecordBatch.from_arrays(waiting, names=_NODE)
        for k in np.flatnonzero(~closed):
            left[:, at[0 if first[k] == 0 else count - 1] + depth] = node[:, k]
        child, below = first[closed], node[:, closed]
        waiting = None
        if len(child):
            spot = at[child] + depth
            leaf = below[CHILDREN] == 0
            below[LEAVES, leaf] = 1
            below[SAVED] += (below[N] - 1) * chars[spot]
            m, root = len(child), np.full(len(child), depth == 0)
            parent = _digests(key[spot - 1] if depth else key[spot], np.full(m, depth <= 1))
            waiting = [pa.array(np.zeros(m, bool)), *[pa.nulls(m, pa.binary())] * 3, _digests(key[spot], root), parent, pa.nulls(m, pa.int64()),
                       *(pa.array(x) for x in (below[LEAST], np.full(m, depth), below[N], below[CHILDREN], below[LEAVES], below[SAVED])),
                       pa.array(below[ENDED] > 0)]
    if waiting is not None:
        yield pa.RecordBatch.from_arrays(waiting, names=_NODE)
    if not last:
        ends = [0] if rows[0][1] == rows[-1][1] else [0, count - 1]
        out = [[True] * len(ends), [rows[k][1] for k in ends], [rows[k][2] for k in ends],
               [np.ascontiguousarray(left[:, at[k]:at[k + 1]]).tobytes() for k in ends]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _NODE_TYPES, strict=False)]
                                         + [pa.nulls(len(ends), t) for t in _NODE_TYPES[4:]], names=_NODE)


def peel(level: DataFrame, count: int, size: int, last: bool, block: int = BLOCK, fewest: int = FEWEST) -> DataFrame:
    """One round: closed nodes of every block, and the two paths of it that stay open.

    Tasks follow the paths and the ``size`` of the level, some blocks each: its rows are too small for
    their bytes to say how much work they are.  No task gets so few paths that a round wouldn't shorten the level.
    """
    tasks = max(level.sparkSession.sparkContext.defaultParallelism, size // (8 * block))
    tasks = max(1, min(tasks, count // (8 * fewest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "chars", "sums")), strict=True):
                held.append(row)
                size += len(row[1]) // DIGEST + 1
                if not last and size >= block and len(held) >= fewest:
                    yield from peeled(held, last)
                    held, size = [], 0
        if held:
            yield from peeled(held, last)

    dealt = level.coalesce(1) if last else level.repartitionByRange(tasks, "path", "conv_id")
    return dealt.sortWithinPartitions("path", "conv_id").mapInArrow(run, _NODE_SCHEMA)


def ends(found: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, ends_sha256): digest of the ids, ascending and comma-joined, of the conversations with the same path.

    Ids travel as spans of ids, so a path that many share is few rows; the digest takes them in order.
    """
    rows = found.select(F.expr(f"substr(path, greatest(octet_length(path) - {DIGEST - 1}, 1))").alias("key"),
                        F.floor(F.col("conv_id") / span).alias("span"), "conv_id")
    rows = rows.groupBy("key", "span").agg(F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return rows.repartition("key").sortWithinPartitions("key", "span").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(rows: DataFrame, block: int = BLOCK, fewest: int = FEWEST, broadcast: int = BROADCAST) -> DataFrame:
    """Every node of the trie over ``rebuilt`` rows, one row per node, with its key and its parent's.

    (key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256);
    key: digest of the turns that lead to it, empty for the root.  Without conversations there is no node.
    """
    found = stored(paths(rows), "trie-paths")
    level, rounds, last = found, [], False
    while True:
        count, length = level.agg(F.count("*"), F.sum(F.octet_length("path"))).first()
        size = count + (length or 0) // DIGEST
        last = bool(rounds) and (count <= fewest or size <= block)
        done = stored(peel(level, count, size, last, block, fewest), "trie-nodes")
        rounds.append(done.where("NOT open").select(*_NODE[4:]))
        if last:
            break
        level = done.where("open").select("conv_id", "path", "chars", "sums")
    every = rounds[0]
    later = rounds[-1]
    for k, more in enumerate(rounds[1:]):
        every = every.union(more)
        later = more if k == 0 else later.union(more)
    # a parent that was open when its child closed is among the later rounds' nodes
    orphan = (F.col("depth") > 0) & F.col("parent_conv_id").isNull()
    top = later.select(F.col("key").alias("parent"), F.col("conv_id").alias("top"))
    top = F.broadcast(top) if top.count() <= broadcast else top
    adopted = every.where(orphan).join(top, "parent").withColumn("parent_conv_id", F.col("top")).drop("top")
    every = every.where(~orphan).unionByName(adopted)
    named = every.where("ended").join(ends(found), "key").unionByName(
        every.where("NOT ended").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return named.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``nodes`` of the rebuilt conversations (conv_id, turn, role, text); other columns are not read."""
    return nodes(rebuilt(stored(turns(conversations), "trie-turns"), group, heads))
