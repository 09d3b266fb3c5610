"""Streams against batch results; file sources; registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwire.operators.model import model_of
from siftwire.plans.jobs import judge
from siftwire.sources import readers, sinks
from siftwire.streaming import scoring as st

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages benchmark labels conversations".split()


def test_scored_stream_equals_batch(spark, tmp_path):
    weights = spark.createDataFrame([("word", "cash", 1.5, 3.0), ("char", "cas", 1.2, 1.0)], "kind string, gram string, idf double, w double")
    model = model_of(weights, -1.0, 2)
    rows = spark.createDataFrame([(1, "free cash"), (2, "hello"), (3, " "), (4, "x" * 10001)], "msg_id long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    st.score_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("msg_id", "verdict", "spam_probability").orderBy("msg_id").collect()
    want = judge(rows.where("msg_id < 3"), model).select("msg_id", "verdict", "spam_probability").orderBy("msg_id").collect()
    assert got == want and len(got) == 2
    bad = spark.read.parquet(f"{tmp_path}/bad").orderBy("msg_id").collect()
    assert [(r.msg_id, r.status) for r in bad] == [(3, "empty"), (4, "too_long")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ham\tone\ttwo\nspam\tthree\nother\tx\nham\t  \n", encoding="utf-8")
    rows = readers.read_labelled_lines(spark, str(tmp_path / "a.tsv")).collect()
    assert {(r.text, r.label) for r in rows} == {("one\ttwo", 0), ("three", 1)}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "l1.csv").write_bytes("v1,v2\nspam,café\n".encode("latin-1"))
    (tmp_path / "csv" / "u8.csv").write_bytes('v1,v2\nham ,"two\n""lines"" ₹"\nham,NA\n'.encode())
    rows = readers.read_labelled_csv(spark, str(tmp_path / "csv"), "v1", "v2").collect()
    assert {(r.text, r.label) for r in rows} == {("café", 1), ('two\n"lines" ₹', 0)}
    (tmp_path / "m.csv").write_text('Subject,Message,Spam/Ham\n,body,spam\nhi,,ham\n,,ham\n')
    rows = readers.read_subject_body_csv(spark, str(tmp_path / "m.csv"), "Subject", "Message", "Spam/Ham").collect()
    assert {(r.text, r.label) for r in rows} == {("body", 1), ("hi", 0)}
    (tmp_path / "g.json").write_text('{"categories": [{"id": "a", "examples": [{"lang": "Hindi", "text": "t"}]},\n {"id": "b", "examples": []}]}')
    assert [(r.category, r.expected, r.text) for r in readers.read_gallery(spark, str(tmp_path / "g.json")).collect()] == [("a", "spam", "t")]


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(' "q", \n x', 1, "s"), ("plain\\", 0, "t")], "text string, label int, source string")
    sinks.export_corpus(rows, f"{tmp_path}/c")
    assert sorted(sinks.import_corpus(spark, f"{tmp_path}/c").collect()) == sorted(rows.collect())


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [
    "a3_subject_body", "a11_input_gate", "b2_html_to_text", "b5_first_wins", "c2_caps_words", "d4_term_frequency", "d5_vocabulary",
    "e1_stratified_split", "e4_score", "e7_group_metrics", "f5_word_scores", "g11_classify_links", "h_all_flags", "i9_blockers",
    "j1_decide", "k2_misses", "l3_first_arrivals"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = plain(df.collect(), df.columns), plain(want.fetchall(), want.columns)
    assert got == expected and got


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).agg(F.count("*")).first()[0] == 1000
