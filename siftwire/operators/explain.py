"""Exact explanations of a linear score: contributions, top features, word scores, highlight spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.rows import bound, explode_rows
from .features import damped, expanded, term_table
from .grams import BIAS, importable
from .model import TOP_SLACK, Model
from .normal import with_normalised

# --- fixed values: report sizes and the smallest score that is highlighted -----------------------------
TOP_K = 8
MAX_WORDS = 3
MIN_SPAN = 0.02

_ENTRY = "array<struct<kind:string,item:string,at:bigint>>"


def _entry(kind: str, item: Column, at: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.alias("item"), at.cast("bigint").alias("at"))


def _hits_of_word(word: Column, after: Column, pos: Column) -> Column:
    """What points at this word (or at this word and the next), with the position.

    A character gram points at a word exactly when it is one of the windows of the padded word, so the
    word stands for its windows, which are cut later and joined by equality instead of testing grams
    against words.
    """
    def of_tokens(own: Column) -> Column:
        ones = F.transform(F.array_distinct(own), lambda x: _entry("word", x, pos))
        following = t.word_tokens(after)

        def pairs(a: Column) -> Column:
            rest = F.slice(own, F.array_position(own, a).cast("int") + 1, F.size(own))
            seconds = F.array_distinct(F.concat(following, rest))
            return F.flatten(F.transform(seconds, lambda b: F.transform(
                F.when(F.array_contains(own, b), F.array(pos)).otherwise(F.array(pos, pos + 1)),
                lambda at: _entry("word", F.concat(a, F.lit(" "), b), at))))

        two = F.when(after.isNotNull(), F.flatten(F.transform(F.array_distinct(own), pairs))).otherwise(
            F.array().cast(_ENTRY))
        return F.concat(ones.cast(_ENTRY), two.cast(_ENTRY))

    return F.concat(F.array(_entry("char", word, pos)).cast(_ENTRY), bound(t.word_tokens(word), of_tokens))


def feature_table(messages: DataFrame, model: Model, id_col: str = "msg_id", words: str = "norm",
                  chars: str = "norm_short", at_rest: bool = False, top: int | None = None, first_of_word: bool = False) -> DataFrame:
    """One row per known feature of a message: id, kind, gram, x, c, hits (positions it points at).

    Features are counted and placed by chunks of texts, of which only the distinct grams travel to meet the model.
    ``top`` gives of each message only those that may be among its ``top`` most positive or negative ones, rounded to four places.
    ``first_of_word`` leaves of the positions with equal words only the first: a word may stand in a long text a thousand times.
    ``at_rest``: the messages lie placed by id, and their features are built row by row where they lie.
    """
    if at_rest:
        return _features_at_rest(messages, model, id_col, words, chars)
    among = None if top is None else ("w", top, TOP_SLACK)
    known = term_table(messages, id_col, words, chars).known(model.joinable(), ("w",), top=among, hits="words" if first_of_word else "all")
    return known.select(id_col, "kind", "gram", "x", (F.col("x") * F.col("w")).alias("c"), "hits")


@dataclass
class Pointing:
    """The features of messages where they arise, for results that are folded there: no row of (message, gram) is made."""

    messages: DataFrame
    model: Model
    id_col: str = "msg_id"
    words: str = "norm"
    chars: str = "norm_short"

    def folded(self, by: str) -> DataFrame:
        return getattr(term_table(self.messages, self.id_col, self.words, self.chars), by)(self.model.weights, "w")


def _features_at_rest(messages: DataFrame, model: Model, id_col: str, words: str, chars: str) -> DataFrame:
    """The same by column expressions and a join by gram: counting, block norms and every later step by message or word
    position reuse the placement.  Words are gathered with their counts and positions before their windows are cut.
    """
    rows = messages.select(id_col, *dict.fromkeys((words, chars)))
    nowhere = F.lit(None).cast("bigint")
    counted = F.concat(F.transform(t.word_grams(t.word_tokens(F.col(words))), lambda g: _entry("word", g, nowhere)),
                       F.transform(t.split_words(F.col(chars)), lambda w: _entry("char", w, nowhere)))
    split = rows.select(id_col, counted.cast(_ENTRY).alias("_counted"), t.split_words(F.col(words)).alias("_words"))
    parts = F.concat(
        F.array(F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("word"),
                         F.lit(None).cast("string").alias("after"), F.col("_counted").alias("counted"))),
        F.transform("_words", lambda w, i: F.struct(
            i.cast("bigint").alias("pos"), w.alias("word"), F.get(F.col("_words"), i + 1).alias("after"),
            F.lit(None).cast(_ENTRY).alias("counted"))))
    per_word = explode_rows(split, [id_col], parts, None, "w")
    entries = F.when(F.col("w.pos") < 0, F.col("w.counted")).otherwise(
        _hits_of_word(F.col("w.word"), F.col("w.after"), F.col("w.pos")))
    items = explode_rows(per_word, [id_col], entries, None, "e").select(id_col, "e.kind", "e.item", "e.at")
    gathered = items.groupBy(id_col, "kind", "item").agg(
        F.count_if(F.col("at").isNull()).alias("n"), F.collect_set("at").alias("ats"))
    known = expanded(gathered, [id_col, "n", "ats"]).join(model.joinable(), ["kind", "gram"]).where(F.col("kind") != BIAS)
    found = known.groupBy(id_col, "kind", "gram", "idf", "w").agg(
        F.sum("n").alias("tf"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hits"))
    present = found.where("tf > 0")  # a pair across words need not be a feature of the message
    raw = present.withColumn("_x", damped(F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(id_col, "kind")))
    scaled = raw.withColumn("x", F.col("_x") / norm)
    return scaled.select(id_col, "kind", "gram", "x", (F.col("x") * F.col("w")).alias("c"), "hits")


def label_of(kind: Column, gram: Column) -> Column:
    """Spaces of a character gram made visible."""
    return F.when(kind == "char", F.translate(gram, " ", "␣")).otherwise(gram)


def type_of(kind: Column, gram: Column) -> Column:
    return F.when((kind == "word") & F.contains(gram, F.lit(" ")), "phrase").otherwise(kind)


def top_features(features: DataFrame, id_col: str = "msg_id", k: int = TOP_K) -> DataFrame:
    """The k most positive and k most negative rounded contributions of each message."""
    r = features.withColumn("contribution", F.round("c", 4)).where("contribution <> 0")
    up = F.col("contribution") > 0
    block = F.when(F.col("kind") == "word", 0).otherwise(1)
    # one pass for both sides: ties go to the later block and gram on the one, to the earlier on the other
    order = [F.abs("contribution").desc(), F.when(up, -block).otherwise(block),
             F.when(up, F.col("gram")).desc_nulls_last(), F.when(~up, F.col("gram")).asc_nulls_last()]
    both = r.withColumn("side", F.when(up, "spam").otherwise("ham")).withColumn(
        "rank", F.row_number().over(W.partitionBy(id_col, "side").orderBy(*order))).where(F.col("rank") <= k)
    return both.select(
        id_col, "side", F.col("rank").cast("bigint").alias("rank"), label_of(F.col("kind"), F.col("gram")).alias("feature"),
        type_of(F.col("kind"), F.col("gram")).alias("type"), "contribution",
        *(["hits"] if "hits" in features.columns else []))


def source_words(hits: Column, words: Column) -> Column:
    """At most three distinct words a feature points at, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(
        hits, lambda p: F.get(words, p.cast("int"))))), 1, MAX_WORDS)


def word_scores(features: DataFrame | Pointing, id_col: str = "msg_id", rows: bool = True) -> DataFrame | Pointing:
    """Contribution of a feature shared equally by its words; summed by (message, position).

    Given the features where they arise, scores are folded there; without ``rows`` they stay there for ``word_means``.
    """
    if isinstance(features, Pointing):
        return features.folded("word_scores") if rows else features
    shared = features.withColumn("_share", F.try_divide(F.col("c"), F.size("hits").cast("double")))
    rows = explode_rows(shared, [id_col, "_share"], F.col("hits"), None, "pos")
    return rows.groupBy(id_col, "pos").agg(F.sum("_share").alias("score"))


def word_means(normalised: DataFrame, scores: DataFrame | Pointing, id_col: str = "msg_id", words: str = "norm") -> DataFrame:
    """Mean score of every distinct word of a message; words without a score count as 0.

    Given the features where they arise (of the same texts), scores and means are folded there.
    """
    if isinstance(scores, Pointing):
        return scores.folded("word_means")
    placed = explode_rows(normalised.select(id_col, words), [id_col], t.split_words(F.col(words)), "_p", "word")
    placed = placed.select(id_col, F.col("_p").cast("bigint").alias("pos"), "word")
    return placed.join(scores, [id_col, "pos"], "left").groupBy(id_col, "word").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))


def text_tokens(messages: DataFrame, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """White-space tokens of the original text with code-point offsets: id, tok, start, end, token."""
    tokens = t.split_words(F.col(text))
    gaps = F.split(F.col(text), rf"[^{t.rx.SPACE}]+")
    both = F.zip_with(tokens, gaps, lambda a, g: F.struct(a.alias("token"), F.length(g).alias("gap")))
    rows = explode_rows(messages.select(id_col, text), [id_col], both, "tok", "b").where(F.col("b.token").isNotNull())
    upto = F.sum(F.col("b.gap") + F.length("b.token")).over(
        W.partitionBy(id_col).orderBy("tok").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.select(id_col, "tok", F.col("b.token").alias("token"), upto.alias("end"))
    return rows.withColumn("start", F.col("end") - F.length("token"))


def marked(scored: DataFrame, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """Spans of the tokens in ``marks`` (token, score) of every row's text, by code points: id, start, end, text, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, token, score = [], [], [], [], []
            for k, (whole, marks) in enumerate(zip(batch.column(text).to_pylist(), batch.column("marks").to_pylist(), strict=True)):
                marks = {m["token"]: m["score"] for m in marks}
                for found in re.finditer(r"\S+", whole):  # of the white space that split_words knows
                    value = marks.get(found.group())
                    if value is not None:
                        row.append(k)
                        start.append(found.start())
                        end.append(found.end())
                        token.append(found.group())
                        score.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                                              pa.array(token, pa.string()), pa.array(score, pa.float64())], names=[id_col, "start", "end", "text", "score"])

    importable(scored.sparkSession)
    kind = scored.schema[id_col].dataType.simpleString()
    return scored.select(id_col, text, "marks").mapInArrow(run, f"`{id_col}` {kind}, start int, end int, text string, score double")


def highlights(messages: DataFrame, means: DataFrame, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """Spans of the original text whose words carry a score: id, start, end, text, score.

    A token's score depends on its letters alone, so each distinct one of a message is normalised and joined once, and the
    tokens that are marked go back to the text as one list.
    """
    rows = messages.select(id_col, text)
    distinct = explode_rows(rows, [id_col], F.array_distinct(t.split_words(F.col(text))), None, "token")
    tokens = with_normalised(distinct, "token")
    pieces = explode_rows(tokens, [id_col, "token"], t.split_words(F.col("norm")), None, "word")
    scored = pieces.join(means, [id_col, "word"]).groupBy(id_col, "token").agg(F.sum("mean").alias("_s")).where(F.abs("_s") >= MIN_SPAN)
    marks = scored.groupBy(id_col).agg(F.collect_list(F.struct("token", F.round("_s", 3).alias("score"))).alias("marks"))
    return marked(rows.join(marks, id_col), id_col, text)
