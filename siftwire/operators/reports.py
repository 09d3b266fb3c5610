"""Evaluation reports over judged message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import allowlist, rule_table, signal_table
from ..functions.match import literal_map
from ..functions.rows import keep_where
from .verdict import SPAM_AT, UNSURE_HIGH, UNSURE_LOW

# --- fixed values: language codes and categories without a threat level --------------------------------
LANG_CODES = {"English": "EN", "Hinglish": "HI-EN", "Hindi": "HI", "Misspelled": "TYPO"}
FIXED_LEVELS = {"gray": "GRAY", "genuine": "SAFE"}


def ml_call(p: Column) -> Column:
    return F.when(p >= SPAM_AT, "spam").otherwise("ham")


def ml_report(judged: DataFrame, group: str, p: str = "p") -> DataFrame:
    """Model-only passes of every group, with how many probabilities fall in the unsure band."""
    q = F.col(p)
    return judged.groupBy(F.col(group).alias("grp")).agg(
        F.count("*").alias("total"), F.count_if(ml_call(q) == F.col("expected")).alias("passed"),
        F.count_if((q >= UNSURE_LOW) & (q < UNSURE_HIGH)).alias("in_band"))


def probe_report(judged: DataFrame, group: str, p: str = "p") -> DataFrame:
    """total, ml_correct, final_correct and final_unsure of every group."""
    return judged.groupBy(F.col(group).alias("grp")).agg(
        F.count("*").alias("total"), F.count_if(ml_call(F.col(p)) == F.col("expected")).alias("ml_correct"),
        F.count_if(F.col("verdict") == F.col("expected")).alias("final_correct"),
        F.count_if(F.col("verdict") == "unsure").alias("final_unsure"))


def miss_list(judged: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Rows that the model alone or the final verdict gets wrong."""
    out = judged.select(
        *keys, "expected", F.round(p, 3).alias("ml_probability"),
        (ml_call(F.col(p)) == F.col("expected")).alias("ml_correct"), F.col("verdict").alias("final_verdict"),
        F.array_join(F.transform("flags", lambda f: f["id"]), ",").alias("red_flags"),
        F.when(F.col("safe_signal_applied"), F.array_join(F.transform("safe.signals", lambda s: s["id"]), ","))
        .otherwise("").alias("safe_signal"))
    return keep_where(out, ~F.col("ml_correct") | (F.col("final_verdict") != F.col("expected")))


def threat_level(caught: Column, total: Column) -> Column:
    r = F.coalesce(F.try_divide(caught, total), F.lit(1.0))
    return F.when(r >= 1.0, "LOW").when(r >= 0.75, "MED").when(r >= 0.5, "HIGH").otherwise("CRIT")


def category_stats(judged: DataFrame, category: str = "category", p: str = "p") -> DataFrame:
    """total, ml_correct, final_correct and threat level of every category."""
    counts = probe_report(judged, category, p).drop("final_unsure")
    level = F.coalesce(F.try_element_at(literal_map(FIXED_LEVELS), F.col("grp")),
                       threat_level(F.col("ml_correct"), F.col("total")))
    return counts.select(F.col("grp").alias("category"), "total", "ml_correct", "final_correct", level.alias("level"))


def lang_code(lang: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LANG_CODES), lang), F.upper(F.substring(lang, 1, 4)))


def report_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed tables a reader of the reports needs next to the computed ones."""
    return {"rules": rule_table(spark).drop("groups"), "signals": signal_table(spark), "allowlist": allowlist(spark)}
