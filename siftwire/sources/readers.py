"""Labelled message sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.rows import explode_rows

LABELS = ("ham", "spam")
# --- fixed values: cells that a CSV reader with missing-value detection does not give as text ------------
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def parse_labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``label<TAB>text`` lines -> text, label; other columns are kept.

    Split at the first tab; lines that are neither ham nor spam or have a blank text are dropped.
    """
    rest = [c for c in lines.columns if c != value]
    parts = F.split(F.col(value), "\t", 2)
    cut = lines.select(*rest, F.get(parts, F.lit(0)).alias("_l"), F.get(parts, F.lit(1)).alias("text"))
    kept = cut.where(F.col("_l").isin(*LABELS) & ~t.is_blank(F.col("text")))
    return kept.select(*rest, "text", (F.col("_l") == "spam").cast("int").alias("label"))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled_lines(spark.read.text(path))


def select_labelled(rows: DataFrame, label: str, text: str) -> DataFrame:
    """Two named columns -> text, label; rows without text or with another label are dropped."""
    rest = [c for c in rows.columns if c not in (label, text)]
    named = t.strip(F.col(label).cast("string"))
    kept = rows.where(F.col(text).isNotNull() & ~F.col(text).isin(*MISSING) & named.isin(*LABELS))
    return kept.select(*rest, F.col(text).alias("text"), (named == "spam").cast("int").alias("label"))


def _csv(spark: SparkSession, paths: list[str], columns: list[str], encoding: str) -> DataFrame:
    raw = spark.read.csv(paths, header=True, multiLine=True, escape='"', encoding=encoding)
    return raw.select(*[F.col(f"`{c}`") for c in columns])


def utf8_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, utf8): whether the whole file is valid UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))


def read_labelled_csv(spark: SparkSession, path: str, label: str, text: str) -> DataFrame:
    """CSV files, each read as UTF-8 when all of it is, else as latin-1."""
    listing = utf8_files(spark, path).collect()  # one row per file, as in any file listing
    parts = [_csv(spark, paths, [label, text], enc) for enc, ok in (("UTF-8", True), ("ISO-8859-1", False))
             if (paths := sorted(r.path for r in listing if r.utf8 == ok))]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return select_labelled(rows, label, text)


def join_subject_body(rows: DataFrame, subject: str, body: str, label: str) -> DataFrame:
    """Subject, blank line and body as one text; missing parts count as empty, empty texts are dropped."""
    rest = [c for c in rows.columns if c not in (subject, body, label)]

    def part(c: str) -> Column:
        return F.when(F.col(c).isin(*MISSING), "").otherwise(F.coalesce(F.col(c), F.lit("")))

    joined = rows.select(*rest, t.strip(F.concat(part(subject), F.lit("\n\n"), part(body))).alias("text"),
                         F.coalesce(F.col(label) == "spam", F.lit(False)).cast("int").alias("label"))
    return joined.where(F.col("text") != "")


def read_subject_body_csv(spark: SparkSession, path: str, subject: str, body: str, label: str) -> DataFrame:
    return join_subject_body(_csv(spark, [path], [subject, body, label], "UTF-8"), subject, body, label)


def keep_labelled_text(rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    rest = [c for c in rows.columns if c not in (label, text)]
    return rows.where(~t.is_blank(F.col(text))).select(
        *rest, F.col(text).alias("text"), F.coalesce(F.col(label) == "spam", F.lit(False)).cast("int").alias("label"))


def read_labelled_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files (train and test) as one source."""
    return keep_labelled_text(spark.read.parquet(*paths).select("text", "label"))


GALLERY = T.StructType([T.StructField("categories", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("icon", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("expected", T.StringType()), T.StructField("text", T.StringType())])))])))])


def flatten_gallery(nested: DataFrame) -> DataFrame:
    """One row per example: category, title, cat_pos, pos, label, lang, expected, text; other columns are kept."""
    rest = [c for c in nested.columns if c != "categories"]
    cats = explode_rows(nested, rest, F.col("categories"), "cat_pos", "c")
    rows = explode_rows(cats, [*rest, "cat_pos", F.col("c.id").alias("category"), F.col("c.title").alias("title")],
                        F.col("c.examples"), "pos", "e")
    return rows.select(*rest, "category", "title", "cat_pos", "pos", F.col("e.label").alias("label"),
                       F.col("e.lang").alias("lang"), F.coalesce("e.expected", F.lit("spam")).alias("expected"),
                       F.col("e.text").alias("text"))


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    return flatten_gallery(spark.read.schema(GALLERY).json(path, multiLine=True))
