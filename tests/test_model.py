"""Corpus, split, model and explanations."""

import math

import pytest
from pyspark.sql import functions as F

from siftwire.catalog.features import derived_model, light
from siftwire.operators import corpus as c
from siftwire.operators import explain as x
from siftwire.operators import features as f
from siftwire.operators import metrics as mt
from siftwire.operators import model as md
from siftwire.operators import split as sp
from siftwire.plans import jobs

TEXTS = ["free cash now free", "call me now", "free call", "cash for you now", "you call me for cash", "a.b free cash a.b", ""]


@pytest.fixture(scope="module")
def small(spark):
    rows = light(spark.createDataFrame(list(enumerate(TEXTS)), "msg_id long, text string"))
    vocab = f.with_idf(f.vocabulary(f.term_table(rows), {"word": 1, "char": 1}), rows)
    return rows, derived_model(vocab)


def test_contributions_and_words_add_up(small):
    rows, model = small
    z = {r.msg_id: r.z for r in md.score(f.term_table(rows, with_bias=True), model).collect()}
    feats = x.feature_table(rows, model).cache()
    sums = {r.msg_id: r.s for r in feats.groupBy("msg_id").agg(F.sum("c").alias("s")).collect()}
    assert set(z) == set(range(len(TEXTS)))
    for k, v in z.items():
        assert math.isclose(v, sums.get(k, 0.0) - 0.25, abs_tol=1e-9)
    placed = feats.where(F.size("hits") > 0).agg(F.sum("c")).first()[0]
    assert math.isclose(x.word_scores(feats).agg(F.sum("score")).first()[0], placed, abs_tol=1e-9)


def test_spans_count_code_points(spark, small):
    _, model = small
    rows = light(spark.createDataFrame([(1, "😀  free cash")], "msg_id long, text string"))
    tokens = [(r.start, r.end, r.token) for r in x.text_tokens(rows).orderBy("tok").collect()]
    assert tokens == [(0, 1, "😀"), (3, 7, "free"), (8, 12, "cash")]
    means = x.word_means(rows, x.word_scores(x.feature_table(rows, model)))
    assert {r.text for r in x.highlights(rows, means).collect()} <= {"😀", "free", "cash"}


def test_training_separates_and_scores(spark, tmp_path):
    rows = [(i, ("win cash prize " if i % 2 else "see you at lunch ") + f"ref {i % 7}", i % 2, f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "msg_id long, text string, label int, source string")
    model, held = jobs.train(df, str(tmp_path), max_iter=30)
    total = mt.by_group(held, mt.membership(spark, {"two": ("s0", "s1")})).where("grp = 'all'").first()
    assert total.n == 24 and total.f1 == 1.0
    again = md.Model.load(spark, f"{tmp_path}/model")
    assert again.weights.count() == model.n_terms
    out = {r.msg_id: r for r in jobs.analyse(df.select("msg_id", "text"), model).collect()}
    assert len(out) == 120 and out[1].spam_probability > 0.5 > out[0].spam_probability
    assert out[1].top_spam_features and out[1].highlights


def test_split_shares(spark):
    rows = spark.range(1003).select(F.col("id").alias("msg_id"), (F.col("id") % 10 == 0).cast("int").alias("label"),
                                    F.when(F.col("id") < 600, "big").otherwise("small").alias("source"))
    held = sp.test_rows(rows)
    got = {(r.source, r.label): r["count"] for r in held.groupBy("source", "label").count().collect()}
    assert got == {("big", 0): 108, ("big", 1): 12, ("small", 0): 73, ("small", 1): 8}
    ids = {r.msg_id for r in held.collect()}
    assert ids == {r.msg_id for r in sp.test_rows(rows.repartition(3)).collect()}


def test_vocabulary_cap_equals_full_ranking(spark):
    terms = spark.range(4000).select(F.col("id").alias("msg_id"), F.lit("word").alias("kind"),
                                     F.concat(F.lit("g"), F.floor(F.sqrt("id")).cast("string")).alias("gram"), F.lit(1).cast("bigint").alias("tf"))
    counted = sorted(((-r.total, r.gram) for r in f.document_frequency(terms).where("df >= 2").collect()))
    for cap in (1, 10, 37):
        kept = f.vocabulary(terms, max_terms={"word": cap, "char": 1}).collect()
        assert sorted((-r.total, r.gram) for r in kept) == counted[:cap]


def test_first_wins_with_a_hot_key(spark):
    rows = [("Hello  World!" if i % 3 == 0 else f"text {i}", i % 2, i) for i in range(300)]
    late = spark.createDataFrame(rows, "text string, label int, ord long")
    early = spark.createDataFrame([("hello world", 1, 5)], "text string, label int, ord long")
    prepared = c.prepare(c.unify([("early", early), ("late", late)]))
    kept = c.first_wins(prepared)
    assert kept.where("key = 'hello world'").select("source", "copies").collect() == [("early", 101)]
    again = c.first_wins(kept.drop("copies"))
    assert again.count() == kept.count() == 201
    stats = {r.source: (r.kept, r.dropped) for r in c.source_stats(prepared, kept).collect()}
    assert stats == {"early": (1, 0), "late": (200, 100)}
    assert {r.key for r in c.first_wins(prepared.repartition(5)).collect()} == {r.key for r in kept.collect()}
