"""Archives, nearest neighbours, registered queries and the pipeline."""

import gzip
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from siftwire.llm import ann, queries, warc
from siftwire.llm.common import dropped, scratch, stored

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_archive_ranges_cover_each_record_once(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c d", None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "<p>x</p>"),
             (6, "u", "fake \x1f\x8b\x08 magic")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    files = stored(warc.write(warc.planned(df), scratch(spark, "w")), "f")
    whole = None
    for size in (7, 100, 1 << 20):
        cuts = warc.ranges(spark, files, size)
        assert warc.read(cuts).rdd.getNumPartitions() == min(cuts.count(), max(32, cuts.count() // 16))
        rows = sorted((tuple(r)[:1] + tuple(r)[2:6] for r in warc.read(cuts).collect()), key=repr)
        assert whole is None or rows == whole
        whole = rows
    by = {r[0]: r for r in whole}
    assert len(whole) == 7 and by[2][1] == "response" and by[1][1:3] == ("revisit", 2) and by[None][2] == 2 and by[3][1:3] == ("revisit", 4)
    assert by[1][3] == 8 and by[5][3] == 10000
    for path in (r.path for r in files.collect()):
        assert gzip.open(path.removeprefix("file:")).read().count(b"WARC/1.1\r\n") > 0
    assert warc.planned(df, least=100).where("response IS NOT NULL").count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).round(3) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [math.nan] * 16), (None, x[0].tolist()), (9060, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).collect()
    score = x[::20] @ x.T
    score[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 20)) and all([a for a, *_ in sorted(v)] == list(range(1, 11)) for v in found.values())
    assert np.mean([len({v for _, v, _ in found[20 * k]} & set(best[k].tolist())) / 10 for k in range(150)]) >= 0.9
    assert all(abs(s - score[q // 20, v]) < 1e-12 for q, rows_ in found.items() for _, v, s in rows_)


def test_few_vectors_give_all_others_with_ties_by_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 20), (20, 1, 0), (20, 2, 2), (20, 3, 3)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    order = sorted(rows.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, map(tuple, rows.select(order).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in order]).fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_pipeline_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, None, 0), (None, "mail a@b.example.com", "en", "s", 5)], docs.schema)
    docs = docs.union(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), name)
        if k < 4:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            assert out.where("doc_id IN (9001, 9002) OR doc_id IS NULL").count() == 3
        docs = out
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_dropped_table_is_gone_and_no_other(spark):
    df = spark.range(1000).withColumn("x", F.lit("same"))
    first, second = stored(df, "dropped", "zstd"), stored(df, "dropped")
    of = [{f.rsplit("/", 1)[0].removeprefix("file://") for f in t.inputFiles()}.pop() for t in (first, second)]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    dropped(first)
    assert [os.path.exists(path) for path in of] == [False, True] and second.count() == 1000
    dropped(stored(df.limit(0), "dropped"))


def test_a_stored_table_leaves_no_shuffle_files_behind(spark):
    def held():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(os.path.getsize(f) for f in manager.getAllFiles().mkString("\n").split("\n") if os.path.basename(f).startswith("shuffle_"))

    before = held()
    rows = spark.range(300_000).select((F.col("id") % 100_003).alias("k"), F.md5(F.col("id").cast("string")).alias("s")).groupBy("k").agg(F.max("s").alias("s"))
    assert stored(rows, "grouped").count() == 100_003
    assert held() - before < 1 << 20 and rows.count() == 100_003
