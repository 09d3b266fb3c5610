"""Streams: rule verdicts row by row, model scoring by micro-batch, input gate, first-arrival dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..functions.rows import keep_where
from ..operators import corpus as c
from ..operators import verdict as v
from ..operators.model import Model
from ..plans.jobs import judge


def rule_stream(messages: DataFrame, text: str = "text", probability: str = "p") -> DataFrame:
    """Links, flags, safe signals and verdict of rows that carry a probability; stateless."""
    return v.with_verdict(v.with_rules(messages, text), probability)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    # one folder per batch, overwritten whole: a batch that is run again after a failure leaves no copies
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def score_stream(messages: DataFrame, model: Model, out: str, quarantine: str, checkpoint: str,
                 id_col: str = "msg_id", text: str = "text", **trigger) -> StreamingQuery:
    """Gate, score and judge arriving messages; rejected rows go to ``quarantine`` with their status.

    Scoring folds the terms of a message, which on a bare stream would be an unbounded state.  A
    micro-batch holds whole messages, so the batch job runs on it unchanged.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        gated = c.gate(batch, text)
        _write_batch(gated.where("status <> 'ok'"), quarantine, batch_id)
        good = gated.where("status = 'ok'").drop("status")
        _write_batch(judge(good, model, id_col, text), out, batch_id)

    return (messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def gate_streams(messages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) streams of one gated input."""
    gated = c.gate(messages, text)
    return gated.where("status = 'ok'"), gated.where("status <> 'ok'")


def first_arrivals(messages: DataFrame, event_time: str, delay: str, text: str = "text") -> DataFrame:
    """First arrival of every key within the watermark; state older than the delay is dropped."""
    keyed = messages.withColumn("key", t.dedup_key(t.clean(F.col(text))))
    keyed = keep_where(keyed, F.length("key") >= c.MIN_KEY_CHARS)
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])


def to_table(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(out))
