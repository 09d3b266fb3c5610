"""Streams over the events file: same results as the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as f
from ..plans.messages import messages_from, read_table
from ..streaming import scoring as st
from . import sql as q
from .base import add, dealt, msgs, work_dir
from .corpus import clean_sql, key_sql
from .features import derived_model


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return messages_from(dealt(events))


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = work_dir(spark, name)
    st.to_table(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _rules(spark, sf_dir):
    judged = st.rule_stream(arriving(spark, sf_dir)).select("msg_id", "branch", "verdict", "label")
    return _drain(spark, judged, "l1")


add("l1_rule_stream", _rules, q.ctes(*q.WITH_VERDICT) + """ SELECT msg_id, branch, verdict,
  CASE WHEN verdict = 'spam' OR (verdict = 'unsure' AND p >= 0.5) THEN 'spam' ELSE 'ham' END AS label FROM jd""")


#: Files of one micro-batch of the scored stream.
FILES = 4


def _scored(spark, sf_dir):
    """Messages arriving in files, scored by a model over their own vocabulary; rejected ones with their status."""
    path, rows = work_dir(spark, "l1-scored"), msgs(spark, sf_dir).select("msg_id", "text")
    rows.write.parquet(f"{path}/in")
    model = derived_model(f.with_idf(f.vocabulary(f.message_terms(rows)), rows))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    st.score_stream(stream, model, f"{path}/out", f"{path}/rejected", f"{path}/checkpoint").awaitTermination()
    good, bad = (spark.read.parquet(f"{path}/{part}") for part in ("out", "rejected"))
    return good.select("msg_id", F.lit("ok").alias("status"), "verdict", F.round("p", 6).alias("p")).unionByName(
        bad.select("msg_id", "status", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("p")))


add("l1_scored_stream", _scored)


def _gate(spark, sf_dir):
    good, bad = st.gate_streams(arriving(spark, sf_dir).select("msg_id", "text"))
    parts = [_drain(spark, part.select("msg_id", "status"), name) for part, name in ((good, "l2-ok"), (bad, "l2-bad"))]
    return parts[0].unionByName(parts[1])


add("l2_gate_stream", _gate, q.ctes(q.M) + """ SELECT msg_id, CASE WHEN NOT regexp_matches(text, '[^\\s]') THEN 'empty'
  WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS status FROM m""")


def _arrivals(spark, sf_dir):
    timed = arriving(spark, sf_dir).select("msg_id", F.col("ts").cast("timestamp").alias("ts"), "text")
    return _drain(spark, st.first_arrivals(timed, "ts", "3650 days").select("key"), "l3")


add("l3_first_arrivals", _arrivals, q.ctes(q.M) + f""" SELECT DISTINCT key FROM (
  SELECT {key_sql(clean_sql('text'))} AS key FROM m) WHERE length(key) >= 2""")
