"""One registered query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, brown, decontamination, fim, jaccard, lines, pii, secret_scan, suffixes, toxicity, trie, warc
from .common import held_out, scratch, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def tokenizer() -> tuple[str, str]:
    """Rank file and splitting pattern of the installed vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


#: Folds and bound on labelled rows that the toxicity machine learns from.
TOXIC_FOLDS, TOXIC_ROWS = 5, 20_000


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine | None:
    rows = toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXIC_FOLDS, TOXIC_ROWS)
    return toxicity.train(rows)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), TOXIC_FOLDS).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), 4, 85)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learned(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(warc.write(warc.planned(table(spark, sf_dir, "pages")), scratch(spark, "warc")), "warc-files")
    back = warc.read(warc.ranges(spark, files), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top,
             array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
                     CAST((CAST(strpos('0123456789abcdef', substr(sha1(coalesce(html, '')), CAST((5 * k + j) // 4 + 1 AS INTEGER), 1)) - 1 AS INTEGER)
                           >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1 AS INTEGER) << CAST(4 - j AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest
      FROM pages)
"""


@query
def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), 10)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.passages(lines.repeated(table(spark, sf_dir, "documents")))


ORACLES["op5_line_dedup"] = """
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') AS p FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS k FROM pieces),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS until FROM split),
clean AS (
  SELECT doc_id, k, until - length(piece) AS start, until,
         trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS c
  FROM placed),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit, len(string_split(c, ' ')) AS n FROM clean WHERE c <> ''),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept, row_number() OVER w AS place, count(*) OVER (PARTITION BY c) AS times
  FROM units WINDOW w AS (PARTITION BY c ORDER BY doc_id, unit)),
marked AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE times > 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(until) AS BIGINT) AS "end", count(*) AS n_units,
       CAST(sum(n) AS BIGINT) AS n_words, count(*) FILTER (place > 1) AS n_removed, CAST(min(kept) AS BIGINT) AS kept_doc_id
FROM marked GROUP BY doc_id, run HAVING sum(n) >= 30
"""


@query
def repeated_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of repeated units, however short: the rows of ``op5_line_dedup`` and those under its floor."""
    return lines.passages(lines.repeated(table(spark, sf_dir, "documents")), 0)


ORACLES["repeated_line_runs"] = ORACLES["op5_line_dedup"].replace(" HAVING sum(n) >= 30", "")


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("begins", "ends")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations")).drop("key", "parent")


ORACLES["op12_conversation_trie"] = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            unhex(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, x: list_reduce(list_concat([xor(a, x)], [CAST(k AS BIGINT) FOR k IN range(0, 8)]),
             lambda b, k: xor(b >> 1, CASE WHEN b & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS state
  FROM (SELECT DISTINCT c FROM turns)),
heads AS (SELECT c, xor(state, CAST(4294967295 AS BIGINT)) % 6 AS h FROM ids),
built AS (
  SELECT heads.c, 0 AS part, pos, role, text FROM heads JOIN turns ON turns.c = heads.c - heads.c % 100 AND pos <= h
  UNION ALL
  SELECT heads.c, 1, pos, role, text FROM heads JOIN turns ON turns.c = heads.c AND pos > h),
ways AS (
  SELECT heads.c, coalesce(w, []) AS w FROM heads LEFT JOIN (
    SELECT c, list({'role': role, 'text': text} ORDER BY part, pos) AS w FROM built GROUP BY c) b ON b.c = heads.c),
steps AS (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM ways),
members AS (SELECT c, d, md5(CAST(w[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(w[1:d - 1] AS VARCHAR)) END AS pk, len(w) = d AS ended,
                   CASE WHEN d > 0 THEN length(w[d].text) ELSE 0 END AS chars FROM steps),
nodes AS (
  SELECT k, d, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends
  FROM members GROUP BY k, d),
children AS (SELECT pk, count(*) AS m FROM nodes WHERE d > 0 GROUP BY pk),
whole AS (SELECT nodes.*, coalesce(m, 0) AS m FROM nodes LEFT JOIN children ON children.pk = nodes.k),
below AS (
  SELECT top.k, sum(CASE WHEN sub.m = 0 THEN 1 ELSE 0 END) AS leaves, sum((sub.n - 1) * sub.chars) AS saved
  FROM whole sub JOIN members top ON top.c = sub.conv_id AND top.d <= sub.d GROUP BY top.k)
SELECT CAST(whole.conv_id AS BIGINT) AS conv_id, CAST(whole.d AS BIGINT) AS depth, CAST(up.conv_id AS BIGINT) AS parent_conv_id,
       CAST(whole.n AS BIGINT) AS n_convs, CAST(whole.m AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, whole.ends AS ends_sha256
FROM whole JOIN below ON below.k = whole.k LEFT JOIN nodes up ON up.k = whole.pk
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find(docs, secret_scan.learned(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
