"""Term tables: word 1-2 grams and in-word character 3-5 grams, vocabulary, idf, weights of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .grams import BIAS, Terms, in_chunks
from .normal import with_normalised
from .ranking import first_of_group

# --- fixed values: vocabulary limits; the second is off unless a caller passes it ---------------------
MIN_DF = {"word": 2, "char": 3}
MAX_TERMS = {"word": 200_000, "char": 300_000}
#: Counted rows up to which a table of terms is broadcast; larger ones are joined by their key.
BROADCAST_TERMS = 100_000


def placed(df: DataFrame, id_col: str) -> DataFrame:
    """Rows dealt by id over as many tasks as the session shuffles into; every later step by message stays there.

    The number is given, so that it holds: a text is few bytes and many grams, and tasks merged by
    their bytes would be far too large.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def expanded(items: DataFrame, keep: list) -> DataFrame:
    """Rows of ``items`` (kind, item and the ``keep`` columns) with ``gram``: windows of a word of kind char, else the item.

    Generators instead of nested lambdas, so that the work stays in generated code.
    """
    low, high = t.WINDOWS
    padded = items.select(*keep, "kind", F.when(F.col("kind") == "char", F.concat(F.lit(" "), "item", F.lit(" "))).otherwise(F.col("item")).alias("_pad"))
    size = F.length("_pad")
    # a word that is not longer than a window once padded is given whole, once
    lengths = F.when(F.col("kind") == "char", F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(size, F.lit(high))))).otherwise(F.array(F.lit(0)))
    sized = padded.select(*keep, "kind", "_pad", F.explode(lengths).alias("_n"))
    starts = F.sequence(F.lit(1), F.when(F.col("_n") == 0, 1).otherwise(F.greatest(size - F.col("_n") + 1, F.lit(1))))
    windows = sized.select(*keep, "kind", "_pad", "_n", F.explode(starts).alias("_at"))
    gram = F.when(F.col("_n") == 0, F.col("_pad")).otherwise(F.substring(F.col("_pad"), F.col("_at"), F.col("_n")))
    return windows.select(*keep, "kind", gram.alias("gram"))


def term_table(df: DataFrame, id_col: str = "msg_id", words: str = "norm", chars: str = "norm_short",
               with_bias: bool = False, size: Column | None = None) -> Terms:
    """Terms of the messages' texts, dealt into chunks by ``size``, their length (that of ``words`` if not given).

    The texts are placed by id, which is the only shuffle: the grams, some twenty times the text, are
    counted where they arise.  Words are counted first, so a word's windows are cut once a message.
    """
    return in_chunks(df, id_col, words, chars, F.length(words) if size is None else size, with_bias)


def message_terms(messages: DataFrame, id_col: str = "msg_id", text: str = "text", with_bias: bool = False) -> Terms:
    """Terms of raw messages: normalise, then count."""
    rows = with_normalised(messages.select(id_col, F.col(text).alias("text")), "text")
    return term_table(rows, id_col, chars="norm", with_bias=with_bias, size=F.length("text"))


def document_frequency(terms: Terms | DataFrame, min_df: dict | None = None) -> DataFrame:
    """Messages and total count of every gram, or of those in enough messages, added up from the chunks' distinct grams (or from rows of terms)."""
    if isinstance(terms, DataFrame):
        found = terms.groupBy("kind", "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        return found if min_df is None else found.where(F.col("df") >= _by_kind(min_df))
    return terms.frequencies(None if min_df is None else min_df | {BIAS: min_df["char"]})


def _by_kind(values: dict[str, int]) -> Column:
    return F.when(F.col("kind") == "word", values["word"]).otherwise(values["char"])


def vocabulary(terms: Terms | DataFrame, min_df: dict = MIN_DF, max_terms: dict | None = None) -> DataFrame:
    """Grams kept for the model: those in enough messages; with ``max_terms`` the most frequent of them, ties by gram."""
    counted = document_frequency(terms, min_df)
    if max_terms is None:
        return counted
    size_class = -F.floor(F.ln(F.col("total")) * 8)
    return first_of_group(counted, ["kind"], size_class, [F.col("total").desc(), F.col("gram")],
                          _by_kind(max_terms).cast("bigint"))


def idf(n_messages: Column, df: Column) -> Column:
    """Smoothed: ln((1 + n) / (1 + df)) + 1."""
    return F.ln((n_messages + 1.0) / (df + 1.0)) + 1.0


def with_idf(vocab: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``idf``; the number of messages comes as a scalar subquery."""
    n = messages.agg(F.count("*").cast("double").alias("n")).scalar()
    return vocab.withColumn("idf", idf(n, F.col("df")))


def damped(tf: Column) -> Column:
    return F.ln(tf.cast("double")) + 1.0


def by_count(table: DataFrame, n: int | None) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough."""
    return F.broadcast(table) if n is not None and n <= BROADCAST_TERMS else table


def weighted_terms(terms: Terms, vocab: DataFrame, more: tuple = (), grams: bool = True) -> DataFrame:
    """``x`` of every known term, of length one within each (message, kind), and ``more`` columns of ``vocab``."""
    return terms.known(vocab, tuple(more), grams)


def indexed_vocabulary(vocab: DataFrame, path: str) -> DataFrame:
    """Add ``idx``: word block first, then char block, each in gram order, from 0.

    A range sort is written to ``path`` with each row's place in its task; the rows before a task
    are the sum of the counts of the tasks before it, so nothing is brought to one place but those
    counts.
    """
    block = F.when(F.col("kind") == "word", 0).otherwise(1)
    vocab.withColumn("_block", block).orderBy("_block", "gram").withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = vocab.sparkSession.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    # one row a task of the sort
    before = rows.groupBy("_task").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    idx = (F.col("_at") - F.shiftleft(F.col("_task"), 33) + F.col("_before")).alias("idx")
    return rows.join(F.broadcast(before.select("_task", "_before")), "_task").select(*vocab.columns, idx)
