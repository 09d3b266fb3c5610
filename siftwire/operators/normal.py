"""Text normalisation over message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def with_normalised(df: DataFrame, text: str = "text", limits: dict | None = None) -> DataFrame:
    """Add ``norm`` and ``norm_short``, the text that character grams come from.

    Both hold the whole text; ``limits`` (such as ``text.SHORT_TEXTS``) cuts the text to ``norm``
    characters first and ``norm_short`` to its own number.
    """
    limits = limits or {}
    keep = [*df.columns, "norm", "norm_short"]
    df = df.withColumn("_joined", t.undo_pretokenised(t.cut(F.col(text), limits.get("norm"))))
    body = t.squeeze_lower(t.substitute_placeholders(F.col("_joined")))
    mark = F.when(t.caps_count(F.col("_joined")) >= 2, F.lit(" zzcaps")).otherwise(F.lit(""))
    df = df.withColumn("norm", F.concat(body, mark))
    return df.withColumn("norm_short", t.cut(F.col("norm"), limits.get("norm_short"))).select(*keep)


def placeholder_profile(normalised: DataFrame, keys: list[str]) -> DataFrame:
    """Messages and placeholder tokens of each kind within each key."""
    def hits(token: str) -> Column:
        return F.sum(F.regexp_count("norm", F.lit(token))).alias(token)

    return normalised.groupBy(*keys).agg(F.count("*").alias("messages"), *[hits(p) for p in t.PLACEHOLDERS])
