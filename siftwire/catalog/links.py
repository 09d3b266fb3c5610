"""Links, hosts, brands and domain cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hosts as h
from ..functions.rows import explode_rows, keep_where
from ..operators import links as ln
from ..plans.messages import read_table
from . import sql as q
from .base import add, dealt, msgs

# links of both tables under one id
_BOTH = f"""{q.M},
tx AS (SELECT 'page' AS origin, page_id AS id, url AS body FROM pages UNION ALL SELECT 'message', msg_id, text FROM m),
lk AS (SELECT * FROM ({q.link_parts("tx", "origin, id", "body")}) WHERE contains(host, '.'))"""
_HOSTS = f"{_BOTH}, hosts AS (SELECT DISTINCT host FROM lk)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("body"))
    return dealt(pages).unionByName(
        msgs(spark, sf_dir).select(F.lit("message").alias("origin"), F.col("msg_id").alias("id"), F.col("text").alias("body")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ln.with_links(texts(spark, sf_dir), "body")
    return explode_rows(rows, ["origin", "id"], F.col("links"), "pos", "l").select(
        "origin", "id", F.col("pos").cast("bigint").alias("pos"), "l.raw", "l.host", "l.userinfo", "l.kind", "l.owner", "l.brand")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts of all links, before any per-host work."""
    parsed = ln.parse_hosts(texts(spark, sf_dir), "body").select("host")
    return keep_where(parsed, F.contains("host", F.lit("."))).distinct()


add("g1_link_extraction", lambda s, d: found(s, d).select("origin", "id", "pos", "raw"),
    f"WITH {_BOTH} SELECT origin, id, CAST(0 AS BIGINT) AS pos, raw FROM lk")
add("g2_host_parse", lambda s, d: keep_where(
    ln.parse_hosts(texts(s, d), "body").select("origin", "id", "host", "userinfo"), F.col("host").isNotNull()), f"WITH {_BOTH} SELECT origin, id, host, userinfo FROM lk")
add("g3_official_owner", lambda s, d: hosts(s, d).select("host", h.owner_of(F.col("host")).alias("owner")),
    q.ctes(_HOSTS, *q.DIMS, *q.owner_ctes("hosts")) +
    " SELECT host, owner FROM hosts LEFT JOIN owner_of USING (host)")
add("g4_registrable", lambda s, d: hosts(s, d).select("host", h.registrable(F.col("host")).alias("owner_domain")),
    q.ctes(_HOSTS) + f" SELECT host, {q.registrable('host')} AS owner_domain FROM hosts")
add("g5_shortener_neutral", lambda s, d: hosts(s, d).select(
    "host", h.is_shortener(F.col("host")).alias("shortener"), h.is_neutral(F.col("host")).alias("neutral")),
    q.ctes(_HOSTS) + f" SELECT host, host IN {q.names(q.d.SHORTENERS)} AS shortener, {q.NEUTRAL_TEST} AS neutral FROM hosts")
add("g6_host_tokens", lambda s, d: hosts(s, d).select("host", F.array_join(h.host_tokens(F.col("host")), " ").alias("tokens")),
    q.ctes(_HOSTS, f"tk AS ({q.tokens_of('hosts')})") +
    " SELECT host, string_agg(token, ' ' ORDER BY tord) AS tokens FROM tk GROUP BY host")
add("g7_homoglyphs", lambda s, d: explode_rows(
    hosts(s, d), ["host"], h.host_variants(F.col("host")), None, "variant"),
    q.ctes(_HOSTS, f"tk AS ({q.tokens_of('hosts')})", f"va AS ({q.variants_of('tk')})") +
    " SELECT DISTINCT host, variant FROM va")


def _hit_pairs(pairs):
    """(host, brand) for every variant test that holds."""
    def job(spark, sf_dir):
        va = explode_rows(hosts(spark, sf_dir), ["host"], h.host_variants(F.col("host")), None, "variant")
        named = F.array(*[F.when(F.rlike("variant", F.lit("(?s)" + p)), F.lit(n)) for n, p in pairs])
        return explode_rows(va, ["host"], F.array_compact(named), None, "brand").distinct()
    return job


_REGEX_PAIRS = [(n, p) for n, p, _ in q.d.HOST_BRANDS]
_TYPO_PAIRS = [(n, "|".join(h.rx.one_typo(w) for w in ws)) for n, _, ws in q.d.HOST_BRANDS if ws]
add("g8_brand_patterns", _hit_pairs(_REGEX_PAIRS), q.ctes(
    _HOSTS, *q.DIMS, f"tk AS ({q.tokens_of('hosts')})", f"va AS ({q.variants_of('tk')})") +
    " SELECT DISTINCT host, brand FROM va JOIN brands ON regexp_matches(variant, host_re)")
add("g9_one_typo_brands", _hit_pairs(_TYPO_PAIRS), q.ctes(_HOSTS, *q.DIMS, *q.brand_ctes("hosts")) +
    " SELECT DISTINCT host, brand FROM wins")
add("g10_brand_of_host", lambda s, d: hosts(s, d).select("host", h.brand_of_host(F.col("host")).alias("brand")),
    q.ctes(_HOSTS, *q.DIMS, *q.brand_ctes("hosts")) + " SELECT host, brand FROM hosts LEFT JOIN brand_of USING (host)")
add("g11_classify_links", lambda s, d: found(s, d).select("origin", "id", "host", "kind", "owner", "brand"),
    q.ctes(_BOTH, *q.classified()) + " SELECT origin, id, host, kind, owner, brand FROM kd")
add("g11_classify_distinct_hosts", lambda s, d: ln.classify_hosts(ln.parse_hosts(texts(s, d), "body")),
    q.ctes(_HOSTS, "hk AS (SELECT host, '' AS userinfo FROM hosts)", *q.classified("hk")) +
    " SELECT host, kind, owner, brand FROM kd")
add("g12_brands_in_text", lambda s, d: msgs(s, d).select(
    "msg_id", F.array_join(h.brands_in_text(F.col("text")), ",").alias("brands")),
    q.ctes(q.M) + f" SELECT msg_id, array_to_string({q.text_brands('text')}, ',') AS brands FROM m")
add("g13_mask_official", lambda s, d: ln.with_links(msgs(s, d)).select(
    "msg_id", ln.mask_official(F.col("text"), F.col("link_spans")).alias("masked")),
    q.ctes(*q.MESSAGE_LINKS, q.MK) + " SELECT msg_id, masked FROM mk")

_EXPECT = {"official": "official", "challan": "official", "alert": "official", "chat": "neutral"}
_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXPECT.items()) + " ELSE 'lookalike' END"


def _cases(spark, sf_dir):
    cases = msgs(spark, sf_dir).select("msg_id", "category", F.col("text").alias("link"), F.expr(_CASE).alias("expected"))
    graded = ln.case_report(cases, ["msg_id", "category"])
    return graded.groupBy("category", "expected", "got").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"))


add("g14_domain_cases", _cases, q.ctes(*q.MESSAGE_LINKS, q.MK) + f""" SELECT category, {_CASE} AS expected, coalesce(kind, 'none') AS got,
  count(*) AS total, count(*) FILTER (kind = {_CASE}) AS passed FROM mk GROUP BY ALL""")


def _pairs(spark, sf_dir):
    """Two links in one text: a page's and the next page's."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return dealt(pages.join(after, "page_id").select("page_id", F.concat("url", F.lit(" and also "), "other").alias("body")))


_SECOND = f"""tw AS (SELECT page_id, 0 AS pos, url AS body FROM pages WHERE page_id + 1 IN (SELECT page_id FROM pages)
  UNION ALL SELECT page_id - 1, 1, url FROM pages WHERE page_id - 1 IN (SELECT page_id FROM pages)),
two AS (SELECT * FROM ({q.link_parts("tw", "page_id, pos", "body")}) WHERE contains(host, '.'))"""
add("g2_hosts_of_two_links", lambda s, d: keep_where(ln.parse_hosts(_pairs(s, d), "body").select(
    "page_id", F.col("pos").cast("bigint").alias("pos"), "raw", "host", "userinfo"), F.contains("host", F.lit("."))),
    f"WITH {_SECOND} SELECT page_id, CAST(pos AS BIGINT) AS pos, raw, host, userinfo FROM two")
add("g11_classify_two_links", lambda s, d: explode_rows(ln.with_links(_pairs(s, d), "body"), ["page_id"], F.col("links"), "pos", "l").select(
    "page_id", F.col("pos").cast("bigint").alias("pos"), "l.host", "l.kind", "l.owner", "l.brand"),
    q.ctes(_SECOND, *q.classified("two")) + " SELECT page_id, CAST(pos AS BIGINT) AS pos, host, kind, owner, brand FROM kd")
add("g_owner_traffic", lambda s, d: found(s, d).groupBy("origin", "kind", "owner").agg(
    F.count("*").alias("links"), F.count_distinct("host").alias("hosts")),
    q.ctes(_BOTH, *q.classified()) + " SELECT origin, kind, owner, count(*) AS links, count(DISTINCT host) AS hosts FROM kd GROUP BY ALL")
