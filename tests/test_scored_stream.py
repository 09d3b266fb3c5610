"""The model-scored stream: same rows as the batch job, over several batches, and after a batch is run again."""

import os
from pathlib import Path

from pyspark.sql import functions as F
from siftwire.catalog.features import derived_model
from siftwire.operators import corpus as c
from siftwire.operators import features as f
from siftwire.plans import jobs
from siftwire.streaming import scoring as st


def rows_of(df):
    return sorted((r.msg_id, r.verdict, round(r.p, 9)) for r in df.select("msg_id", "verdict", "p").collect())


def test_stream_equals_the_batch_job_and_replays_whole(spark, tmp_path):
    texts = ["WIN cash now, call 09061 to claim your prize", "see you at lunch", "  ", "", "x" * 20_000, "your parcel waits, pay at http://post.example.top/fee"]
    rows = spark.createDataFrame([(k, f"{texts[k % 6]} {k}" if k % 6 not in (2, 3) else texts[k % 6]) for k in range(60)], "msg_id long, text string")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    model = derived_model(f.with_idf(f.vocabulary(f.message_terms(rows)), rows))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        st.score_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/checkpoint").awaitTermination()
        return rows_of(spark.read.parquet(f"{tmp_path}/out")), sorted((r.msg_id, r.status) for r in spark.read.parquet(f"{tmp_path}/bad").collect())

    good, bad = run()
    gated = c.gate(rows, "text")
    assert good == rows_of(jobs.judge(gated.where("status = 'ok'").drop("status"), model))
    assert bad == sorted((r.msg_id, r.status) for r in gated.where("status <> 'ok'").collect()) and len(bad) == 30
    batches = sorted(Path(f"{tmp_path}/checkpoint/commits").glob("[0-9]*"))
    assert len(batches) == 3
    # the last batch was written but its commit is lost: it runs again, over its own folder
    for name in (batches[-1], batches[-1].with_name(f".{batches[-1].name}.crc")):
        if name.exists():
            os.remove(name)
    assert run() == (good, bad)
    assert spark.read.parquet(f"{tmp_path}/out").select(F.countDistinct("batch_id")).first()[0] == 3
