"""Classification metrics per source and per overlapping group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: report groups and the sources in them ----------------------------------------------
GROUPS = {
    "sms_all": ("sms", "india_sms", "india_2011", "hindi_mt"),
    "email_all": ("enron", "spamassassin"),
}


def membership(spark: SparkSession, groups: dict, everything: str = "all") -> DataFrame:
    """(grp, source) pairs; a NULL source stands for every source."""
    rows = [(everything, None)] + [(g, s) for g, members in groups.items() for s in members]
    return spark.createDataFrame(rows, "grp string, source string")


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 4)


def confusion(scored: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    y, q = F.col(label) == 1, F.col(pred) == 1
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~y & ~q).alias("tn"), F.count_if(~y & q).alias("fp"),
        F.count_if(y & ~q).alias("fn"), F.count_if(y & q).alias("tp"))


def rates(counts: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, precision, recall and F1 to four places; 0 where the divisor is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *keys, _ratio(tp + tn, F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "n", "tn", "fp", "fn", "tp")


def by_source(scored: DataFrame) -> DataFrame:
    return rates(confusion(scored, ["source"]), ["source"])


def by_group(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """Metrics of overlapping groups.

    Rows are counted once per source; only those few counts are then joined to the groups, so a
    row in three groups is not copied three times.
    """
    per_source = confusion(scored, ["source"])
    named = per_source.join(groups.where(F.col("source").isNotNull()), "source").select(
        "grp", "n", "tn", "fp", "fn", "tp")
    whole = groups.where(F.col("source").isNull()).select("grp")
    # the group without members takes every source: the counts table is one row per source
    every = per_source.withColumn("grp", whole.select(F.min("grp")).scalar()).select("grp", "n", "tn", "fp", "fn", "tp")
    counts = named.unionByName(every.where(F.col("grp").isNotNull())).groupBy("grp").agg(
        *[F.sum(c).alias(c) for c in ("n", "tn", "fp", "fn", "tp")])
    return rates(counts, ["grp"])
