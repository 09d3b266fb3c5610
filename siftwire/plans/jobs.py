"""Whole jobs: build a corpus, train and evaluate a model, analyse messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import explain as x
from ..operators import features as f
from ..operators import metrics as m
from ..operators import model as md
from ..operators import split as s
from ..operators import verdict as v
from ..operators.normal import with_normalised
from ..sources.sinks import kept_by, shared_dir, write_corpus


def build_corpus(sources: list[tuple[str, DataFrame]], path: str) -> DataFrame:
    """Union, clean, de-duplicate and store; returns the per-source statistics."""
    prepared = c.prepare(c.unify(sources))
    kept = c.first_wins(prepared)
    write_corpus(kept, path)
    return c.source_stats(prepared, prepared.sparkSession.read.parquet(path))


def train(rows: DataFrame, work_dir: str | None = None, id_col: str = "msg_id", max_iter: int = md.MAX_ITER,
          min_df: dict = f.MIN_DF, max_terms: dict | None = None, dense_terms: int = md.DENSE_TERMS) -> tuple[md.Model, DataFrame]:
    """Split, weight, fit and score the held-out part.

    ``rows``: id, text, label, source.  Returns the model and the held-out rows with ``p`` and
    ``pred``.  The split and the normalised texts are written once; terms are counted anew by the stages that
    need them.
    """
    spark = rows.sparkSession
    work_dir = work_dir or shared_dir(spark, "train")
    s.with_split(rows.select(id_col, "label", "source"), id_col).write.mode("overwrite").parquet(f"{work_dir}/split")
    split = spark.read.parquet(f"{work_dir}/split")
    train_ids, test = split.where("split = 'train'"), split.where("split = 'test'")
    # patterns cost far more than a second reading
    with_normalised(rows.select(id_col, "text")).select(id_col, "norm", F.length("text").alias("size")).write.mode("overwrite").parquet(f"{work_dir}/texts")
    texts = spark.read.parquet(f"{work_dir}/texts")

    def terms(ids: DataFrame, with_bias: bool = False) -> f.Terms:
        return f.term_table(texts.join(ids.select(id_col), id_col), id_col, chars="norm", with_bias=with_bias, size=F.col("size"))

    train_terms = terms(train_ids)
    vocab = f.with_idf(f.vocabulary(train_terms, min_df, max_terms), train_ids)
    labels = s.with_weights(train_ids).select(id_col, "label", "weight")
    model = md.fit(train_terms, labels, vocab, work_dir, max_iter=max_iter, dense_terms=dense_terms)
    model.save(f"{work_dir}/model")
    model = md.Model(spark.read.parquet(f"{work_dir}/model"), model.n_terms)
    p = md.score(terms(test, with_bias=True), model)
    held = test.join(p.select(id_col, "p"), id_col).withColumn(
        "pred", F.when(F.col("p") >= v.SPAM_AT, 1).otherwise(0))
    return model, held


def evaluate(held: DataFrame, groups: dict = m.GROUPS) -> dict[str, DataFrame]:
    return {"per_source": m.by_source(held), "groups": m.by_group(held, m.membership(held.sparkSession, groups))}


def probabilities(messages: DataFrame, model: md.Model, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """id, p of every message."""
    terms = f.message_terms(messages.select(id_col, text), id_col, text, with_bias=True)
    return md.score(terms, model).select(id_col, "p")


def judge(messages: DataFrame, model: md.Model, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """Messages with probability, flags, safe signals and verdict.

    The probability is joined to the bare messages; the rules then run on the joined rows, so the
    wide rule columns never go through the shuffle.
    """
    messages = messages.drop("p")  # the model's probability takes the place of one that came along
    joined = messages.join(probabilities(messages, model, id_col, text), id_col)
    return v.with_verdict(v.with_rules(joined, text))


def analyse(messages: DataFrame, model: md.Model, id_col: str = "msg_id", text: str = "text",
            k: int = x.TOP_K, work_dir: str | None = None) -> DataFrame:
    """Full record of every message: verdict, rules, top features both ways, highlights, bias.

    The messages with their normalised texts are placed by id and written once.  Their features are written as they leave
    their chunks, those of a message together, so that sums, top features and word scores are folded before they are
    placed by id; no row of (message, gram) crosses a shuffle.  Verdicts and rules are written likewise.
    """
    work_dir = work_dir or shared_dir(messages.sparkSession, "analyse")
    normalised = with_normalised(f.placed(messages.drop("p"), id_col), text)
    rows = kept_by(normalised, id_col, f"{work_dir}/messages")
    x.feature_table(rows, model, id_col, chars="norm").write.mode("overwrite").parquet(f"{work_dir}/features")
    feats = rows.sparkSession.read.parquet(f"{work_dir}/features")
    bias = model.weights.where(F.col("kind") == f.BIAS).select("w").scalar()
    z = feats.groupBy(id_col).agg(F.sum("c").alias("_z"))
    judged = rows.join(z, id_col, "left").withColumn("p", md.sigmoid(F.coalesce("_z", F.lit(0.0)) + bias)).drop("_z", "norm", "norm_short")
    # the rules make by far the largest plan: written on its own, it is not planned again with every stage of the joins below
    base = kept_by(v.prediction_record(v.with_verdict(v.with_rules(judged, text)), [id_col, text]), id_col, f"{work_dir}/records")
    words = rows.select(id_col, F.split(F.col("norm"), " ").alias("_words"))
    top = x.top_features(feats, id_col, k).join(words, id_col).select(
        id_col, "side", F.struct("rank", "feature", "type", "contribution", x.source_words(
            F.col("hits"), F.col("_words")).alias("words")).alias("f"))
    lists = top.groupBy(id_col).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("f")))).alias(name)
        for side, name in (("spam", "top_spam_features"), ("ham", "top_safe_features"))])
    spans = x.highlights(rows, x.word_means(rows, x.word_scores(feats, id_col), id_col), id_col, text)
    marks = spans.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "score"))).alias("highlights"))
    return base.join(lists, id_col, "left").join(marks, id_col, "left").withColumn("bias", F.round(bias, 3))
