"""Rule, signal, brand and domain tables kept as data, and their DataFrame forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import domains, rules


def allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(domains.OFFICIAL.items()), "domain string, owner string")


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(i, x.id, x.title, x.explanation, x.severity, list(x.groups or [])) for i, x in enumerate(rules.RULES)]
    return spark.createDataFrame(
        rows, "ord int, id string, title string, explanation string, severity string, groups array<string>")


def signal_table(spark: SparkSession) -> DataFrame:
    rows = [(i, x.id, x.title, x.explanation) for i, x in enumerate(rules.SIGNALS)]
    return spark.createDataFrame(rows, "ord int, id string, title string, explanation string")
