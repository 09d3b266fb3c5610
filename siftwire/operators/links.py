"""Link extraction, classification and masking over message tables, and link reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts as h
from ..functions.rows import bound, explode_rows, keep_where


def _parsed(match: Column) -> Column:
    def host_parts(m: Column) -> Column:
        raw = h.trim_link(m)
        return F.struct(m.alias("match"), raw.alias("raw"), h.authority(raw).alias("auth"))

    def with_host(p: Column) -> Column:
        before, after = h.split_userinfo(p["auth"])
        return F.struct(p["match"].alias("match"), p["raw"].alias("raw"), h.host_of(after).alias("host"),
                        F.lower(before).alias("userinfo"))

    return bound(bound(match, host_parts), with_host)


def _classified(p: Column) -> Column:
    seen = F.when(F.contains(p["host"], F.lit(".")), h.classify(p["host"], p["userinfo"]))
    return bound(seen, lambda c: F.struct(
        p["match"].alias("match"), p["raw"].alias("raw"), p["host"].alias("host"),
        p["userinfo"].alias("userinfo"), c["kind"].alias("kind"), c["owner"].alias("owner"),
        c["brand"].alias("brand"), c["official_host"].alias("official_host")))


def link_spans(text: Column) -> Column:
    """One struct per pattern match; ``kind`` is NULL where the match holds no real host."""
    return F.transform(F.transform(h.link_matches(text), _parsed), _classified)


def with_links(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``link_spans`` (every match) and ``links`` (those with a host)."""
    spanned = df.withColumn("link_spans", link_spans(F.col(text)))
    return spanned.withColumn("links", F.filter("link_spans", lambda s: s["kind"].isNotNull()))


def mask_official(text: Column, spans: Column) -> Column:
    """Text with every official link as ``officialsite``; other text untouched."""
    words = F.transform(spans, lambda s: F.when(s["kind"] == "official", F.lit("officialsite")).otherwise(s["match"]))
    woven = F.array_join(F.zip_with(
        F.split(text, h.LINK), words, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    return F.when(F.exists(spans, lambda s: s["kind"] == "official"), woven).otherwise(text)


def link_table(df: DataFrame, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """One row per link: id, pos, raw, host, userinfo, kind, owner, brand."""
    rows = explode_rows(with_links(df.select(id_col, text), text), [id_col], F.col("links"), "pos", "l")
    return rows.select(id_col, "pos", *[F.col(f"l.{c}").alias(c) for c in (
        "raw", "host", "userinfo", "kind", "owner", "brand")])


def parse_hosts(df: DataFrame, url: str) -> DataFrame:
    """One row per link match of a column: the table's columns, pos, raw, host and userinfo; no row without a match."""
    rows = explode_rows(df, df.columns, F.transform(h.link_matches(F.col(url)), _parsed), "pos", "_p")
    return rows.select(*df.columns, "pos", F.col("_p.raw").alias("raw"), F.col("_p.host").alias("host"),
                       F.col("_p.userinfo").alias("userinfo"))


def classify_hosts(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Distinct hosts with kind, owner and brand.

    Hosts repeat heavily in real traffic, so the distinct (a partial aggregate) comes first and
    the brand patterns run once per host.
    """
    base = keep_where(hosts.select(host), F.contains(host, F.lit("."))).distinct()
    out = base.withColumn("_c", h.classify(F.col(host), F.lit("")))
    return out.select(host, *[F.col(f"_c.{c}").alias(c) for c in ("kind", "owner", "brand")])


def case_report(cases: DataFrame, key: list[str], link: str = "link", expected: str = "expected") -> DataFrame:
    """Expected against found kind of the first link of each case (``none`` without a link)."""
    first = F.get(F.col("links"), F.lit(0))["kind"]
    graded = with_links(cases, link).withColumn("got", F.coalesce(first, F.lit("none")))
    return graded.select(*key, link, expected, "got", (F.col("got") == F.col(expected)).alias("passed"))
