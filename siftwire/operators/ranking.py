"""Exact first-n of each group without one task sorting a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_group(df: DataFrame, group: list[str], coarse: Column, order: list[Column], quota: Column) -> DataFrame:
    """Rows among the first ``quota`` of their group under ``order``.

    ``coarse`` never decreases along ``order`` and takes few values (a hash prefix, a size
    class).  Counts per coarse value tell which values lie wholly inside the quota; those rows
    pass unsorted, and only the value that the quota cuts through is ranked.
    """
    keys = [*group, "_coarse"]
    tagged = df.withColumn("_coarse", coarse).withColumn("_quota", quota)
    cells = tagged.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_quota").alias("_q"))
    run = W.partitionBy(*group).orderBy("_coarse").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumn("_upto", F.sum("_n").over(run)).select(
        *keys, (F.col("_q") - F.col("_upto") + F.col("_n")).alias("_room"),
        (F.col("_upto") <= F.col("_q")).alias("_whole")).where("_room > 0")
    placed = tagged.join(cells, keys)
    columns = df.columns
    whole = placed.where("_whole").select(*columns)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    edge = placed.where("NOT _whole").withColumn("_rank", rank).where("_rank <= _room").select(*columns)
    return whole.unionByName(edge)
