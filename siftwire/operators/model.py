"""Linear model over the term table: fit, weights table, scoring, global top weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import written
from . import solver
from .features import by_count, indexed_vocabulary, weighted_terms
from .grams import BIAS, Terms

# --- fixed values: regularisation and iterations ----------------------------------------------------
C = 10.0
MAX_ITER = 3000
#: Vocabulary up to which Spark ML's solver is used, which keeps a dense vector of it on the driver and
#: in every task; larger ones are fitted by ``solver``, whose coefficients stay in a table.
DENSE_TERMS = 2_000_000
#: More than rounding to four places moves two values against each other.
TOP_SLACK = 1.1e-4

_VECTOR = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()),
                        T.StructField("features", VectorUDT())])


@dataclass
class Model:
    """``weights``: kind, gram, idf, w, with one ``bias`` row; ``n_terms``, its counted rows, decides how it is joined."""

    weights: DataFrame
    n_terms: int

    def joinable(self) -> DataFrame:
        """Broadcast when the counted rows are few enough; a plain join beyond that."""
        return by_count(self.weights, self.n_terms)

    def save(self, path: str) -> None:
        written(self.weights, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        weights = spark.read.parquet(path)
        return Model(weights, weights.count())


def bias_row(spark: SparkSession, bias: float) -> DataFrame:
    return spark.createDataFrame([(BIAS, "", 0.0, float(bias))], "kind string, gram string, idf double, w double")


def model_of(weights: DataFrame, bias: float, n_terms: int) -> Model:
    """Model from a (kind, gram, idf, w) table of ``n_terms`` counted rows."""
    cols = [F.col("kind"), F.col("gram"), F.col("idf").cast("double"), F.col("w").cast("double")]
    return Model(weights.select(*cols).unionByName(bias_row(weights.sparkSession, bias)), n_terms + 1)


def feature_rows(terms: Terms, indexed: DataFrame, size: int) -> DataFrame:
    """Sparse rows ``(id, features)`` in the storage layout of an ML vector, constant feature last."""
    ones = F.lit(size)
    return terms.vectors(indexed).select(terms.id_col, F.struct(
        F.lit(0).cast("tinyint").alias("type"), (ones + 1).alias("size"),
        F.concat(F.col("at").cast("array<int>"), F.array(ones)).alias("indices"), F.concat("x", F.array(F.lit(1.0))).alias("values")).alias("features"))


def fit(terms: Terms, labels: DataFrame, vocab: DataFrame, work_dir: str, c: float = C, max_iter: int = MAX_ITER, dense_terms: int = DENSE_TERMS) -> Model:
    """Weighted L2 logistic regression; ``labels`` holds id, label, weight; ``vocab`` kind, gram, idf.

    The penalty covers the bias too, so the bias is the weight of a constant feature.  Vectors are
    written once to ``work_dir`` (shared storage): the optimizer passes over them many times, and a
    lost executor re-reads a file instead of recomputing the n-grams.  Read back under the vector
    type, they never pass through Python.  A vocabulary of over ``dense_terms`` rows is fitted without
    any vector of its length: same objective, coefficients in a table.
    """
    spark, id_col = vocab.sparkSession, terms.id_col
    indexed = indexed_vocabulary(vocab.select("kind", "gram", "idf"), f"{work_dir}/vocabulary")
    size = indexed.count()
    if size > dense_terms:
        learned, bias = solver.fit_blocks(terms.blocks(indexed), labels, size, work_dir, id_col, c, max_iter)
        return model_of(indexed.join(learned, "idx").select("kind", "gram", "idf", "w"), bias, size)
    rows = feature_rows(terms, indexed, size)
    bare = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size + 1).alias("size"),
                    F.array(F.lit(size)).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    # a message without a single known term still counts, with its constant feature alone
    training = labels.join(rows, id_col, "left").select(
        F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
        F.coalesce("features", bare).alias("features"))
    training.write.mode("overwrite").parquet(f"{work_dir}/vectors")
    vectors = spark.read.schema(_VECTOR).parquet(f"{work_dir}/vectors")
    total = vectors.agg(F.sum("weight")).first()[0]
    fitted = LogisticRegression(
        weightCol="weight", standardization=False, fitIntercept=False, elasticNetParam=0.0,
        regParam=1.0 / (c * total), maxIter=max_iter, tol=1e-6).fit(vectors)
    coefficients = fitted.coefficients.toArray()
    learned = spark.createDataFrame(pa.table({"idx": np.arange(size), "w": coefficients[:size]}))
    weights = indexed.join(learned, "idx").select("kind", "gram", "idf", "w")
    return model_of(weights, float(coefficients[size]), size)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def contributions(terms: Terms, model: Model, top: int | None = None) -> DataFrame:
    """``c = x * w`` of every known term: id, kind, gram, x, c.

    ``top`` gives of each message only those that may be among its ``top`` most positive or negative ones, rounded to four places.
    """
    among = None if top is None else ("w", top, TOP_SLACK)
    known = terms.known(model.joinable(), ("w",), top=among).where(F.col("kind") != BIAS)
    return known.select(terms.id_col, "kind", "gram", "x", (F.col("x") * F.col("w")).alias("c"))


def score(terms: Terms, model: Model) -> DataFrame:
    """Probability of every message: id, z, p.  ``terms`` carries the bias rows.

    The terms of a message lie in one chunk, where they are added up.
    """
    return terms.sums(model.weights, "w").select(terms.id_col, "z", sigmoid(F.col("z")).alias("p"))


def top_weights(model: Model, k: int = 20, kind: str | None = None) -> DataFrame:
    """The k largest and k smallest weights: side, rank order by weight, kind, gram, w."""
    from functools import reduce

    terms = model.weights.where(F.col("kind") != BIAS)
    if kind:
        terms = terms.where(F.col("kind") == kind)
    sides = [
        terms.orderBy(F.col("w").desc(), "kind", "gram").limit(k).withColumn("side", F.lit("spam")),
        terms.orderBy(F.col("w").asc(), "kind", "gram").limit(k).withColumn("side", F.lit("ham")),
    ]
    return reduce(lambda a, b: a.unionByName(b), sides).select("side", "kind", "gram", "w")
