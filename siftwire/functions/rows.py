"""Row-shape helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, items: Column, pos: str | None, item: str) -> DataFrame:
    """One row per array element.

    The outer form plus a filter on its output, because for a plain ``explode`` the optimizer adds
    a size filter on the array, pushes it below the projection that computes the array, and the
    array is then built twice.
    """
    if pos is None:
        rows = df.select(*keep, F.posexplode_outer(items).alias("_pos", item))
        return rows.where(F.col("_pos").isNotNull()).drop("_pos")
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` for conditions on computed columns.

    A plain filter is pushed below the projections that compute its columns and repeats their
    work, once per reference and again for every column those columns use.  A filter on the output
    of a generator stays where it is.
    """
    mark = F.when(condition, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return explode_rows(df, df.columns, mark, None, "_keep").drop("_keep")


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def with_compact(df: DataFrame, name: str, items: list[Column], kind: str) -> DataFrame:
    """Add an array column of the items that are not null, of type ``kind``.

    What a lambda function's argument holds is interpreted, not compiled.  So the items are a column of their
    own, which the optimizer keeps apart because it is used twice.
    """
    rows = df.withColumn("_items", F.array(*items))
    some = F.exists("_items", lambda x: x.isNotNull())
    return rows.withColumn(name, F.when(some, F.array_compact("_items")).otherwise(F.array().cast(kind))).drop("_items")
