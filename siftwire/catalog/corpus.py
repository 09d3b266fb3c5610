"""Sources, sinks and corpus preparation."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities
from ..functions import text as t
from ..operators import corpus as c
from ..plans.messages import read_table
from ..sources import readers, sinks
from . import sql as q
from .base import add, docs, msgs, work_dir

_LABEL = "CASE l.toxic WHEN 1 THEN 'spam' WHEN 0 THEN 'ham' ELSE 'unknown' END"
_LABELLED = f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_STRIP = rf"'^{_SPACE}+|{_SPACE}+$'"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a ham / spam / unknown cell."""
    name = F.when(F.col("toxic") == 1, "spam").when(F.col("toxic") == 0, "ham").otherwise("unknown")
    return docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "text", "lang", "source", name.alias("cell"))


# A1
def _lines(spark, sf_dir):
    lines = labelled(spark, sf_dir).select(
        "doc_id", F.concat("cell", F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    return readers.parse_labelled_lines(lines)


add("a1_labelled_lines", _lines, f"""
SELECT doc_id, replace(text, chr(10), ' ') AS text, CAST(toxic = 1 AS INTEGER) AS label
FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '[^\\s]')""")


# A2
def _csv(spark, sf_dir):
    path = work_dir(spark, "a2")
    padded = labelled(spark, sf_dir).select(F.concat(F.lit(" "), "cell").alias("Kind"), F.col("text").alias("Msg"))
    padded.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False)
    return readers.read_labelled_csv(spark, path, "Kind", "Msg")


add("a2_labelled_csv", _csv, f"""
SELECT text, CAST(toxic = 1 AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)""")


# A3
def _subject(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(
        "doc_id", F.substring_index("text", "\n", 1).alias("Subject"),
        F.when(F.contains("text", F.lit("\n")), F.expr("substr(text, instr(text, '\n') + 1)")).alias("Message"),
        F.col("cell").alias("Kind"))
    return readers.join_subject_body(rows, "Subject", "Message", "Kind")


add("a3_subject_body", _subject, f"""
SELECT doc_id, regexp_replace(split_part(text, chr(10), 1) || chr(10) || chr(10) ||
         CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END, {_STRIP}, '', 'g') AS text,
       CAST({_LABEL} = 'spam' AS INTEGER) AS label
FROM (SELECT d.*, l.toxic {_LABELLED}) l""")


# A4
def _parquet(spark, sf_dir):
    path = work_dir(spark, "a4")
    rows = labelled(spark, sf_dir).select("text", F.col("cell").alias("label"))
    rows.where("label = 'spam'").write.parquet(f"{path}/train")
    rows.where("label <> 'spam'").write.parquet(f"{path}/test")
    return readers.read_labelled_parquet(spark, f"{path}/train", f"{path}/test")


add("a4_parquet_files", _parquet, f"""
SELECT text, CAST({_LABEL} = 'spam' AS INTEGER) AS label {_LABELLED} WHERE regexp_matches(text, '[^\\s]')""")


# A5
def _encodings(spark, sf_dir):
    path = work_dir(spark, "a5")
    rows = labelled(spark, sf_dir).select(F.col("cell").alias("v1"), F.col("text").alias("v2"), "lang")
    for lang_test, enc in (("lang = 'en'", "UTF-8"), ("lang <> 'en'", "ISO-8859-1")):
        rows.where(lang_test).drop("lang").write.mode("append").csv(
            path, header=True, quoteAll=True, escape='"', encoding=enc, ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False)
    return readers.read_labelled_csv(spark, path, "v1", "v2")


add("a5_encoding_fallback", _encodings, """
SELECT text, CAST(toxic = 1 AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)""")


# A6, B5 - B7: conversations before documents before benchmark items before messages
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").select(
        "text", F.when(F.col("role") == "user", 1).otherwise(0).alias("label"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    doc = labelled(spark, sf_dir).select(
        "text", F.when(F.col("cell") == "spam", 1).otherwise(0).alias("label"), F.col("doc_id").alias("ord"))
    item = read_table(spark, sf_dir, "benchmark").select("text", F.lit(0).alias("label"), F.col("item_id").alias("ord"))
    sms = msgs(spark, sf_dir).select(
        "text", F.when(F.col("expected") == "spam", 1).otherwise(0).alias("label"), F.col("msg_id").alias("ord"))
    return c.unify([("chat", conv), ("doc", doc), ("item", item), ("sms", sms)])


_CORPUS = f"""{q.M},
cp AS (SELECT text, CAST(role = 'user' AS INTEGER) AS label, 'chat' AS source, 0 AS prio, conv_id * 1000 + turn AS ord
         FROM conversations
  UNION ALL SELECT d.text, CAST(coalesce(l.toxic = 1, false) AS INTEGER), 'doc', 1, d.doc_id {_LABELLED}
  UNION ALL SELECT text, 0, 'item', 2, item_id FROM benchmark
  UNION ALL SELECT text, CAST(expected = 'spam' AS INTEGER), 'sms', 3, msg_id FROM m)"""


def clean_sql(col: str) -> str:
    e = f"regexp_replace(replace({col}, chr(13), ''), '[ \\t\\f\\x0B]+', ' ', 'g')"
    e = f"regexp_replace({e}, '\\n{_SPACE}*\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({e}, {_STRIP}, '', 'g')"


def key_sql(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


_PREP = f"""{_CORPUS},
pp AS (SELECT * FROM (SELECT *, {key_sql('clean')} AS key FROM (SELECT *, {clean_sql('text')} AS clean FROM cp))
       WHERE length(key) >= 2),
wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, ord) AS rn,
         count(*) OVER (PARTITION BY key) AS copies FROM pp) WHERE rn = 1)"""

add("a6_unified_corpus", lambda s, d: corpus(s, d).groupBy("source", "prio", "label").agg(
    F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.max("ord").alias("last_ord")),
    f"WITH {_CORPUS} SELECT source, prio, label, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
    "max(ord) AS last_ord FROM cp GROUP BY ALL")


# A7
def _round_trip(spark, sf_dir):
    path = work_dir(spark, "a7")
    rows = labelled(spark, sf_dir).select(
        "text", F.when(F.col("cell") == "spam", 1).otherwise(0).alias("label"), "source")
    sinks.export_corpus(rows, f"{path}/csv")
    sinks.write_corpus(sinks.import_corpus(spark, f"{path}/csv"), f"{path}/parquet")
    return sinks.read_corpus(spark, f"{path}/parquet")


add("a7_corpus_round_trip", _round_trip, f"""
SELECT d.text, CAST(coalesce(l.toxic = 1, false) AS INTEGER) AS label, d.source {_LABELLED}""")


# A8
def _gallery(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    example = F.struct(F.col("turn").cast("string").alias("label"), F.lit("English").alias("lang"),
                       F.lit(None).cast("string").alias("expected"), F.col("text").alias("text"))
    by_role = turns.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", example.alias("e")))).alias("es"))
    nested = by_role.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("role").alias("id"), F.col("role").alias("title"),
        F.transform("es", lambda x: x["e"]).alias("examples")))).alias("categories"))
    path = work_dir(spark, "a8")
    nested.write.json(path)
    schema = f"conv_id bigint, categories {readers.GALLERY['categories'].dataType.simpleString()}"
    flat = readers.flatten_gallery(spark.read.schema(schema).json(path))
    return flat.select("conv_id", "category", F.col("pos").cast("bigint").alias("pos"), "label", "expected", "text")


add("a8_nested_gallery", _gallery, """
SELECT conv_id, role AS category, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos,
       CAST(turn AS VARCHAR) AS label, 'spam' AS expected, text FROM conversations""")

# A11
add("a11_input_gate", lambda s, d: c.gate(msgs(s, d)).select("msg_id", "category", "status"),
    q.ctes(q.M) + """ SELECT msg_id, category, CASE WHEN NOT regexp_matches(text, '[^\\s]') THEN 'empty'
    WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS status FROM m""")

# B1 - B7
add("b1_clean_text", lambda s, d: docs(s, d).select("doc_id", t.clean(F.col("text")).alias("text")),
    f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")


def _html_sql() -> str:
    """Tags as above; references by a join of every start of a piece with the table of names, longest first."""
    e = "regexp_replace(html, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?i)<br\\s*/?>|</p>|</div>|</tr>', chr(10), 'g')"
    e = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"

    def spelled(s: str) -> str:
        return " || ".join(f"chr({ord(x)})" for x in s)

    names = ", ".join(f"({q.quoted(name)}, {spelled(value)})" for name, value in html5.items())
    c1 = ", ".join(spelled(x) for x in entities.C1)
    return f"""WITH names(name, val) AS (VALUES {names}),
base AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, {e} AS t FROM pages),
cut AS (SELECT rid, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM base),
starts AS (SELECT rid, i, p, unnest(generate_series(2, least(length(p), 32))) AS k FROM cut WHERE i > 1),
found AS (SELECT rid, i, arg_max(val, k) AS val, max(k) AS k FROM starts JOIN names ON names.name = p[1:k] GROUP BY rid, i),
nums AS (SELECT rid, i, p, regexp_extract(p, '^#0*([0-9]+)', 1) AS d, regexp_extract(p, '^#[xX]0*([0-9a-fA-F]+)', 1) AS h FROM cut
         WHERE i > 1 AND regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])')),
valued AS (SELECT rid, i, p, CASE WHEN length(d) > 7 OR length(h) > 6 THEN 1114112 WHEN d <> '' THEN d::BIGINT ELSE ('0x' || h)::BIGINT END AS n FROM nums),
chars AS (SELECT rid, i, regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') AS rest,
  CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN [{c1}][n - 127]
       WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN ''
       ELSE chr(n::INT) END AS val FROM valued),
parts AS (SELECT c.rid, c.i, CASE WHEN c.i = 1 THEN c.p WHEN h.val IS NOT NULL THEN h.val || h.rest
    WHEN f.k IS NOT NULL THEN f.val || c.p[f.k + 1:] ELSE '&' || c.p END AS v
  FROM cut c LEFT JOIN chars h ON c.rid = h.rid AND c.i = h.i LEFT JOIN found f ON c.rid = f.rid AND c.i = f.i),
whole AS (SELECT rid, string_agg(v, '' ORDER BY i) AS text FROM parts GROUP BY rid)
SELECT b.page_id, w.text FROM base b LEFT JOIN whole w ON b.rid = w.rid"""


add("b2_html_to_text", lambda s, d: read_table(s, d, "pages").select("page_id", t.html_to_text(F.col("html")).alias("text")),
    _html_sql())
add("b3_dedup_key", lambda s, d: docs(s, d).select("doc_id", t.dedup_key(F.col("text")).alias("key")),
    f"SELECT doc_id, {key_sql('text')} AS key FROM documents")
add("b4_short_keys", lambda s, d: c.prepare(corpus(s, d)).groupBy("source").agg(
    F.count("*").alias("kept"), F.min(F.length("key")).cast("bigint").alias("shortest")),
    f"WITH {_PREP} SELECT source, count(*) AS kept, min(length(key)) AS shortest FROM pp GROUP BY source")
add("b5_first_wins", lambda s, d: c.first_wins(c.prepare(corpus(s, d))).select(
    "source", "ord", "label", "copies", F.md5("text").alias("text_md5")),
    f"WITH {_PREP} SELECT source, ord, label, copies, md5(clean) AS text_md5 FROM wn")


def _stats(spark, sf_dir):
    prepared = c.digested(c.prepare(corpus(spark, sf_dir)), work_dir(spark, "b6"))
    return c.source_stats(prepared, c.first_wins(prepared))


add("b6_source_stats", _stats, f"""WITH {_PREP}
SELECT p.source, count(w.rn) AS kept, count(w.rn) FILTER (p.label = 1) AS spam, count(w.rn) FILTER (p.label = 0) AS ham,
       count(*) - count(w.rn) AS dropped
FROM pp p LEFT JOIN wn w ON p.source = w.source AND p.ord = w.ord GROUP BY p.source""")
add("b7_dataset_counts", lambda s, d: c.dataset_counts(c.first_wins(c.prepare(corpus(s, d)))), f"""WITH {_PREP}
SELECT source, count(*) AS messages, count(*) FILTER (label = 1) AS spam, count(*) FILTER (label = 0) AS ham
FROM wn GROUP BY source""")
