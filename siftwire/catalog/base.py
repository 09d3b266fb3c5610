"""Registry of checked queries: a Spark job and, where SQL can say it, the same result in DuckDB SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.messages import messages_from, read_table
from ..sources.sinks import shared_dir

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def add(name: str, job: Job, sql: str | None = None) -> None:
    QUERIES[name] = job
    if sql is not None:
        ORACLES[name] = sql


#: Tasks a core over which a cluster deals a table that lies in fewer parts.
TASKS = 3


def dealt(df: DataFrame) -> DataFrame:
    """The table in as many parts as the session's ``spark.siftwire.partitions`` asks for.

    Pattern work is bound by the processor, and a table may lie in a few files of large row groups: a
    few tasks.  Unset, a session in one process deals it over its threads, and a cluster over some tasks a
    core if it lies in fewer parts (a stream always); a table of more parts is read as it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = int(spark.conf.get("spark.siftwire.partitions", None) or 0)
    if not parts and spark.sparkContext.master.startswith("local["):
        parts = cores
    if not parts and (df.isStreaming or df.rdd.getNumPartitions() < TASKS * cores):
        parts = TASKS * cores
    return df.repartition(parts) if parts else df


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of dealt events: an event is a few numbers, its message may be long."""
    return messages_from(dealt(read_table(spark, sf_dir, "events")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, "documents"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh shared folder; a session in one process that names none gets a temporary one."""
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) or not master.startswith("local") or master.startswith("local-cluster"):
        return shared_dir(spark, name)
    return f"{tempfile.mkdtemp(prefix='siftwire-')}/{name}"
