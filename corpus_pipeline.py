"""The training-data pipeline: documents through five operators, each stage written and read again.

Every stage takes all that its predecessor kept and, but for the last, returns the columns of
documents.  Rows with null text pass the filters and end as documents without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwire.llm import bpe, decontamination, jaccard, pii, toxicity
from siftwire.llm.common import stored, table
from siftwire.llm.queries import TOXIC_FOLDS, TOXIC_ROWS, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the machine, trained on the labelled ones among them, doesn't score as toxic."""
    machine = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), TOXIC_FOLDS, TOXIC_ROWS))
    return toxicity.score(docs, machine, keep=tuple(docs.columns), out="toxic_score_").where("toxic_score_ < 0.5").drop("toxic_score_")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Of rows with one id, all stay or go.  Documents without words or id stay.
    """
    found = jaccard.components(docs, 5, 80)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no stretch with a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets and n_chars counted anew."""
    return pii.redact(docs, pii.learned(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian 32-bit) of every remaining document's whole text."""
    ranks, pattern = tokenizer()
    return bpe.encode(docs, ranks, pattern, keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_similar), ("decontamination", drop_benchmark),
          ("personal_data", redact), ("byte_bpe", encode)]

#: Trained scores, fields and tokenizers are beyond SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
