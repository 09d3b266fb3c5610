"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from siftwire.catalog import QUERIES

HEADLINE = (
    "b5_first_wins", "b2_html_to_text", "c5_normalise", "d4_term_frequency", "d5_vocabulary", "e1_stratified_split",
    "e3_fit_and_evaluate", "e4_score", "f2_top_features", "g11_classify_links", "g11_classify_distinct_hosts", "h_all_flags", "j1_decide",
    "l1_rule_stream",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("siftwire-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # the tables are single files of one row group; each would otherwise be one task
        .config("spark.siftwire.partitions", cpus).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="siftwire-bench-"))
        # call sites of column expressions are captured one by one otherwise, which costs more than planning
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 2)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
