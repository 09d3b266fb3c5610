"""Corpus preparation: union of sources, cleaning, first-wins de-duplication, per-source counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.rows import keep_where

MIN_KEY_CHARS = 2


def unify(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All sources as ``text, label, source, prio, ord``; earlier sources have priority.

    ``ord`` is the row order inside a source: a column of that name, else the file order.
    """
    parts = []
    for prio, (name, df) in enumerate(sources):
        order = F.col("ord").cast("bigint") if "ord" in df.columns else F.monotonically_increasing_id()
        parts.append(df.select("text", F.col("label").cast("int").alias("label"), F.lit(name).alias("source"),
                               F.lit(prio).alias("prio"), order.alias("ord")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def prepare(corpus: DataFrame) -> DataFrame:
    """Cleaned text and its key; rows with a key under two characters dropped."""
    cleaned = corpus.withColumn("text", t.clean(F.col("text")))
    keyed = cleaned.withColumn("key", t.dedup_key(F.col("text")))
    return keep_where(keyed, F.length("key") >= MIN_KEY_CHARS)


def digested(prepared: DataFrame, path: str) -> DataFrame:
    """What counts of prepared rows need, written once: label, source, order and, for the key, its SHA-256.

    Cleaning is the larger part of such counts, and texts and whole keys would cross their shuffles.
    """
    prepared.select("label", "source", "prio", "ord", F.sha2("key", 256).alias("key")).write.mode("overwrite").parquet(path)
    return prepared.sparkSession.read.parquet(path)


def first_wins(prepared: DataFrame) -> DataFrame:
    """One row per key: the first by (priority, row order).

    ``min_by`` combines inside each map task, so a key that a third of all rows share still sends
    one row per task.  The hash in front makes the sort inside the aggregate compare numbers.
    """
    payload = [c for c in prepared.columns if c not in ("key",)]
    won = prepared.groupBy(F.xxhash64("key").alias("_h"), "key").agg(
        F.min_by(F.struct(*payload), F.struct("prio", "ord")).alias("_w"), F.count("*").alias("copies"))
    return won.select("key", *[F.col(f"_w.{c}").alias(c) for c in payload], "copies")


def source_stats(prepared: DataFrame, kept: DataFrame) -> DataFrame:
    """kept, spam, ham and duplicates dropped of every source."""
    seen = prepared.groupBy("source").agg(F.count("*").alias("seen"))
    won = kept.groupBy("source").agg(F.count("*").alias("kept"), F.count_if(F.col("label") == 1).alias("spam"))
    n = F.coalesce(F.col("kept"), F.lit(0))
    spam = F.coalesce(F.col("spam"), F.lit(0))
    return seen.join(won, "source", "left").select(
        "source", n.alias("kept"), spam.alias("spam"), (n - spam).alias("ham"), (F.col("seen") - n).alias("dropped"))


def dataset_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(
        F.count("*").alias("messages"), F.count_if(F.col("label") == 1).alias("spam"),
        F.count_if(F.col("label") == 0).alias("ham"))


def gate(messages: DataFrame, text: str = "text", limit: int = t.GATE_CHARS) -> DataFrame:
    """Add ``status``: ok, empty or too_long."""
    c = F.col(text)
    return messages.withColumn("status", F.when(t.is_blank(c), "empty").when(F.length(c) > limit, "too_long").otherwise("ok"))
