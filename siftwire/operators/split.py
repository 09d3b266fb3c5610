"""Stratified split within each source and per-cell sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import first_of_group

SEED = 42
TEST_PERCENT = 20


def test_quotas(rows: DataFrame) -> DataFrame:
    """Test rows of every (source, label): the source's share rounded up, spread by largest remainder."""
    cells = rows.groupBy("source", "label").agg(F.count("*").alias("n"))
    of_source = W.partitionBy("source")  # a handful of labels per source
    total = F.sum("n").over(of_source)
    cells = cells.withColumn("_total", total).withColumn(
        "_test", F.expr(f"(_total * {TEST_PERCENT} + 99) div 100"))
    cells = cells.withColumn("_base", F.expr("(_test * n) div _total")).withColumn("_rest", F.expr("(_test * n) % _total"))
    left = F.col("_test") - F.sum("_base").over(of_source)
    place = F.row_number().over(of_source.orderBy(F.col("_rest").desc(), "label"))
    return cells.withColumn("_left", left).withColumn("_place", place).select(
        "source", "label", "n",
        (F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def draw(id_col: Column, seed: int = SEED) -> Column:
    """Reproducible draw order of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def test_rows(rows: DataFrame, id_col: str = "msg_id", seed: int = SEED) -> DataFrame:
    """Held-out ids with source and label.

    There are few strata and any of them may hold most rows, so nothing is ranked by stratum as a
    whole: rows are counted by the first digits of their draw and only the digits at the edge of
    the quota are ordered.
    """
    lean = rows.select(id_col, "source", "label")
    drawn = lean.join(test_quotas(lean).select("source", "label", "quota"), ["source", "label"])
    drawn = drawn.withColumn("_draw", draw(F.col(id_col), seed))
    won = first_of_group(drawn, ["source", "label"], F.substring("_draw", 1, 3),
                         [F.col("_draw"), F.col(id_col)], F.col("quota"))
    return won.select(id_col, "source", "label")


def with_split(rows: DataFrame, id_col: str = "msg_id", seed: int = SEED) -> DataFrame:
    held = test_rows(rows, id_col, seed).select(id_col, F.lit(True).alias("_held"))
    return rows.join(held, id_col, "left").withColumn(
        "split", F.when(F.col("_held"), "test").otherwise("train")).drop("_held")


def cell_weights(rows: DataFrame) -> DataFrame:
    """Weight of every (source, label): 1/sqrt(n), scaled so that the weights of all rows average 1."""
    cells = rows.groupBy("source", "label").agg(F.count("*").alias("n"))
    scale = cells.agg((F.sum("n") / F.sum(F.sqrt("n"))).alias("s")).scalar()
    return cells.withColumn("weight", scale / F.sqrt("n"))


def with_weights(rows: DataFrame) -> DataFrame:
    """Rows with their cell weight; the cell table is tiny and joined by whatever join its size calls for."""
    return rows.join(cell_weights(rows).select("source", "label", "weight"), ["source", "label"])
