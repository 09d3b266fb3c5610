"""What the operators share: tables, scratch tables on shared storage, word hashes, dealt arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a task remembers with their hash before it starts afresh.
CACHE_WORDS = 250_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; where it is installed that changes nothing."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of sessions in one process, by application.
_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``.

    A session in one process may leave it unset; a temporary folder then serves.  On a cluster that
    is an error, since executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local.setdefault(app, "") or tempfile.mkdtemp(prefix="siftwire-llm-")
        _local[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a job as it ends; otherwise they stay until the driver finds them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The table written once, by the session's codec or a named one, and read again: lineage ends here, and no later loss repeats the work.

    The shuffle files behind it are deleted with the end of the write.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once what was made of it is written too."""
    spark = table.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most so many rows, cut earlier once ``column`` has so many bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            done = int(ends[start - 1]) if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(start, end - start)
            start = end


def buckets(spark: SparkSession) -> int:
    """Groups that dealt arrays go to: as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(key, folds: int):
    """Whether crc32 of the key as text falls into fold 0; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def in_fold(key, folds: int) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == 0


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash; each word is hashed once as long as it is remembered (``most`` words at a time)."""

    def __init__(self, most: int = CACHE_WORDS):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; fewer words give one shingle, no words none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = hashes[:n] * _MIX
    for k in range(1, width):
        out = (out + hashes[k:k + n]) * _MIX
    return mixed(out + np.uint64(width))


def cut(arrays: list[np.ndarray], to: np.ndarray, n: int) -> Iterator[tuple[int, list[bytes]]]:
    """Parallel arrays dealt by ``to`` into ``n`` parts: (part, one byte string per array), no empty parts."""
    order = np.argsort(to.astype(np.uint16) if n <= 1 << 16 else to, kind="stable")  # 16 bits are sorted by their digits
    edges = np.searchsorted(to[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    for k in range(n):
        if edges[k] < edges[k + 1]:
            yield k, [a[edges[k]:edges[k + 1]].tobytes() for a in arrays]


def joined(parts, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype)


def connected(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every linked node: the smallest node it can reach.

    Rounds of linking each node's larger neighbours, then its smaller ones, to the least of the
    neighbourhood; each round is a written table.  A hub's edges are aggregated map-side and never
    gathered.  ``links`` has u, v (long); order and repeats don't matter.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), name)
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, name)
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == last:
            break
        last = tuple(sums)
    tops = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tops.union(edges.select("v", "v").distinct())
