"""Substring dedup by hashing lines: of equal units the earliest stays, the rest go where they make up a passage.

Lines are cut at sentence ends, since a passage that repeats often sits inside longer lines.  A unit is
normalised to its words with A-Z lower-cased and one space between; units without words don't count.
Neighbouring units that repeat make up a run, and a run of enough words is a repeated passage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, words

#: Words from which on a run of repeated units is reported and removed; 0 takes every repeated unit.
RUN_WORDS = 30
#: Digests that may travel with the tasks: those with over this part of all units each.
HOT = 100_000

UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_NAMES = ["row", "doc_id", "of", "unit", "start", "n_chars", "n_words", "digest"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def units(docs: DataFrame) -> DataFrame:
    """(row, doc_id, of, unit, start, n_chars, n_words, digest): every unit with words, numbered within its row.

    ``start`` is its offset in code points; ``row`` tells rows apart, ``of`` is a hash of the whole text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for row, doc, of, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "of", "text")), strict=True):
                start = unit = 0
                for piece in UNIT.findall(text or ""):
                    found = words(piece)
                    if found:
                        out.append((row, doc, of, unit, start, len(piece), len(found), hashlib.md5(b" ".join(found)).digest()))
                        unit += 1
                    start += len(piece)
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    return numbered.mapInArrow(run, "row long, doc_id long, of long, unit int, start long, n_chars int, n_words int, digest binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def repeated(docs: DataFrame) -> DataFrame:
    """Units that occur more than once: those of ``units`` with ``first``, the earliest place, and ``removed``.

    Places rank by document, then unit; a null id ranks before all others.  Rows with the same id and
    text are one document and keep or lose the same units.  Null and empty texts have no units.
    """
    found = stored(units(docs), "line-units")
    place = F.struct("doc_id", "unit", "of", "start")
    # only the first place of a digest and its count cross the shuffle from each task
    first = stored(found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-digests")
    # a unit in a great many places is one key: such digests, fewer than HOT by their counts, travel with the tasks instead
    least = found.count() // HOT
    rows = found.join(first.where(F.col("n") <= least) if least else first, "digest")
    if least:
        rows = rows.union(found.join(F.broadcast(first.where(F.col("n") > least)), "digest"))
    return rows.withColumn("removed", ~place.eqNullSafe(F.col("first"))).drop("n")


def runs(marked: DataFrame) -> DataFrame:
    """Neighbouring repeated units as one row: row, doc_id, start, end, n_units, n_words, n_removed, kept_doc_id, first_unit, last_unit.

    ``n_removed`` units of it have an earlier place; ``kept_doc_id`` is the earliest document that has one of its units.
    """
    order = Window.partitionBy("row").orderBy("unit")
    return (marked.withColumn("run_", F.col("unit") - F.row_number().over(order)).groupBy("row", "run_").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max(F.col("start") + F.col("n_chars")).alias("end"),
        F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"), F.count_if("removed").alias("n_removed"),
        F.min("first").getField("doc_id").alias("kept_doc_id"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit")).drop("run_"))


def passages(marked: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_units, n_words, n_removed, kept_doc_id): runs of at least so many words, of every holder, the earliest included."""
    found = runs(marked).where(F.col("n_words") >= least_words)
    return found.select("doc_id", "start", "end", "n_units", "n_words", "n_removed", "kept_doc_id")


def removed(marked: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """(row, doc_id, of, unit, start, end, kept_doc_id, kept_start): units of such runs that have an earlier place."""
    order = Window.partitionBy("row").orderBy("unit")
    run = Window.partitionBy("row", "run_")
    long = (marked.withColumn("run_", F.col("unit") - F.row_number().over(order)).withColumn("words_", F.sum("n_words").over(run))
            .where((F.col("words_") >= least_words) & F.col("removed")))
    return long.select("row", "doc_id", "of", "unit", "start", (F.col("start") + F.col("n_chars")).alias("end"),
                       F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def kept_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents with the spans of ``removed`` taken out of their texts; the others stay as they are.

    Spans are gathered by document: as many as its units.
    """
    lists = gone.groupBy("doc_id", "of").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))  # apart from the columns' own names
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("of"))
    rows = rows.join(lists, same, "left")
    text, start = F.col("doc.text"), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate("spans", start, lambda a, s: F.struct(
        F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    kept = F.when(F.col("spans").isNull(), text).otherwise(kept)
    return rows.select(*[kept.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
