"""Red-flag rules: one array column of flags per message, plus flag reports.

Every rule is a column expression over the text and the link array of its own row, so the whole
set is one projection without a shuffle and works on streams.  Groups are tested in order and the
snippets are only extracted for rows where all of them occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import rules as r
from ..functions import hosts as h
from ..functions.match import Message, all_of, first, fold, has, literal_map, snippets
from ..functions.needles import needles_in
from ..functions.rows import bound, explode_rows, with_compact
from .grams import importable
from .links import mask_official, with_links

FLAG_TYPE = "array<struct<id:string,severity:string,matched:array<string>>>"


def _flag(rule_id: str, severity: Column, matched: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("id"), severity.alias("severity"), snippets(matched).alias("matched"))


def _grouped(rule: r.Rule, text: Message) -> Column:
    return F.when(all_of(text, rule.groups), _flag(
        rule.id, F.lit(rule.severity), F.array(*[first(text, g) for g in rule.groups])))


def _all_official(links: Column) -> Column:
    return (F.size(links) > 0) & F.forall(links, lambda x: x["kind"] == "official")


def _kyc_block(text: Message, links: Column) -> Column:
    excused = _all_official(links) & ~has(text, r.PHONE)
    note = F.array(F.lit(r.KYC_OFFICIAL_NOTE))

    def either(base: list[str], link: str) -> Column:
        """High with the link snippet; medium with the note when every link is official."""
        high = F.array(*[first(text, p) for p in [*base, link]])
        if link is r.CALL_OR_LINK:
            medium = F.concat(high, note)
        else:
            medium = F.concat(F.array(*[first(text, p) for p in base]), note)
        return F.when(excused, _flag("kyc_block", F.lit("medium"), medium)).otherwise(
            _flag("kyc_block", F.lit("high"), high))

    threat_only = F.array(first(text, r.KYC_THREAT), first(text, r.KYC_DEMAND))
    widened = (
        F.when(has(text, r.KYC_LINK_OR_NUMBER), either([r.KYC_THREAT, r.KYC_DEMAND], r.KYC_LINK_OR_NUMBER))
        .when(~has(text, r.KYC_BRANCH), _flag("kyc_block", F.lit("medium"), threat_only)))
    return (
        F.when(all_of(text, (r.KYC_ENTITY, r.KYC_BLOCKISH, r.CALL_OR_LINK)),
               either([r.KYC_ENTITY, r.KYC_BLOCKISH], r.CALL_OR_LINK))
        .when(all_of(text, (r.KYC_THREAT, r.KYC_DEMAND)), widened))


def _prize_claim(text: Message) -> Column:
    return (
        F.when(has(text, r.PRIZE_STRONG),
               _flag("prize_claim", F.lit("high"), F.array(first(text, r.PRIZE_STRONG))))
        .when(all_of(text, (r.PRIZE_WIN, r.PRIZE_WHAT)),
              _flag("prize_claim", F.lit("high"), F.array(first(text, r.PRIZE_WIN), first(text, r.PRIZE_WHAT)))))


def _lookalike(links: Column) -> Column:
    fakes = F.filter(links, lambda x: x["kind"] == "lookalike")

    def lines(x: Column) -> Column:
        return F.array_compact(F.array(
            F.when(x["userinfo"] == "", x["host"]).otherwise(x["raw"]),
            # a decoy can imitate a brand only as a whole; the report then names none
            F.concat(F.lit("imitates "), F.coalesce(x["brand"], F.lit("None"))),
            F.when(x["owner"] != x["host"], F.concat(F.lit("real owner: "), x["owner"]))))

    return F.when(F.exists(links, lambda x: x["kind"] == "lookalike"),
                  _flag("lookalike_domain", F.lit("high"), F.flatten(F.transform(fakes, lines))))


def _brand_mismatch(text: Column, links: Column) -> Column:
    stray = F.filter(links, lambda x: x["kind"].isin("shortener", "other"))

    def near(x: Column) -> Column:
        at = F.instr(text, x["raw"])  # first place of the link, also for a repeated one
        start = F.greatest(at - r.ACTION_BEFORE, F.lit(1))
        window = F.when(at > 0, F.substring(
            text, start, at - start + F.length(x["raw"]) + r.ACTION_AFTER)).otherwise(text)
        return bound(window, lambda w: F.struct(
            x["host"].alias("host"), x["kind"].alias("kind"),
            F.when(has(Message(w), r.ACTION), h.brands_in_text(w)).alias("brands")))

    def report(bad: Column) -> Column:
        named = F.slice(F.array_distinct(F.flatten(F.transform(bad, lambda x: x["brands"]))), F.lit(1), F.lit(2))
        return F.when(F.size(bad) > 0, _flag("brand_link_mismatch", F.lit("medium"), F.concat(
            F.transform(named, lambda b: F.concat(F.lit("mentions "), b)),
            F.transform(F.slice(bad, F.lit(1), F.lit(2)), lambda x: F.concat(
                F.lit("link goes to "), x["host"],
                F.when(x["kind"] == "shortener", F.lit(" (URL shortener)")).otherwise(F.lit("")))))))

    bad = F.filter(F.transform(stray, near), lambda x: F.coalesce(F.size(x["brands"]) > 0, F.lit(False)))
    return F.when(
        F.exists(links, lambda x: x["kind"].isin("shortener", "other"))
        & ~F.exists(links, lambda x: x["kind"] == "lookalike"), bound(bad, report))


def _suspicious_link(masked: Message) -> Column:
    return _grouped(r.RULE_BY_ID["suspicious_link"], masked)


def rule_column(rule_id: str, text: Message, links: Column, masked: Message) -> Column:
    """``struct<id, severity, matched>`` where the rule fires, else NULL."""
    if rule_id == "kyc_block":
        return _kyc_block(text, links)
    if rule_id == "prize_claim":
        return _prize_claim(text)
    if rule_id == "lookalike_domain":
        return _lookalike(links)
    if rule_id == "brand_link_mismatch":
        return _brand_mismatch(text.column, links)
    if rule_id == "suspicious_link":
        return _suspicious_link(masked)
    return _grouped(r.RULE_BY_ID[rule_id], text)


def with_needles(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_needles`` for the substring tests; dropped again by the operators that need it."""
    if "_needles" in df.columns:
        return df
    importable(df.sparkSession)
    return df.withColumn("_needles", needles_in(fold(F.col(text))))


def _with_masked(df: DataFrame, text: str) -> DataFrame:
    """Add ``_masked`` and, where it differs from the text, ``_masked_folded``."""
    df = df.withColumn("_masked", mask_official(F.col(text), F.col("link_spans")))
    changed = F.exists("link_spans", lambda x: x["kind"] == "official")
    return df.withColumn("_masked_folded", F.when(changed, fold(F.col("_masked"))))


def with_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``flags``; link columns are added when missing."""
    if "links" not in df.columns:
        df = with_links(df, text)
    keep = [*df.columns, "flags"]
    df = _with_masked(with_needles(df, text), text)
    msg, masked = Message(text, needles="_needles"), Message("_masked", "_masked_folded", "_needles")
    fired = [rule_column(rule.id, msg, F.col("links"), masked) for rule in r.RULES]
    return with_compact(df, "flags", fired, FLAG_TYPE).select(*keep)


def single_rule(df: DataFrame, rule_id: str, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """Messages on which one rule fires, with severity and snippets.

    A rule that looks at the text alone does no link work.
    """
    rule = r.RULE_BY_ID[rule_id]
    by_text = rule_id == "prize_claim" or (rule.groups is not None and rule_id != "suspicious_link")
    base = with_needles(df.select(id_col, text), text)
    msg = Message(text, needles="_needles")
    if by_text:
        flagged = base.select(id_col, rule_column(rule_id, msg, F.lit(None), msg).alias("_f"))
    else:
        masked = Message("_masked", "_masked_folded", "_needles")
        flagged = _with_masked(with_links(base, text), text).select(
            id_col, rule_column(rule_id, msg, F.col("links"), masked).alias("_f"))
    # an array explode keeps the computed struct from being evaluated again by a pushed-down filter
    rows = explode_rows(flagged, [id_col], F.array_compact(F.array("_f")), None, "f")
    return rows.select(id_col, F.col("f.severity").alias("severity"), F.col("f.matched").alias("matched"))


def display_flags(flags: Column) -> Column:
    """Flags with title and explanation, for people."""
    titles = literal_map({x.id: x.title for x in r.RULES})
    texts = literal_map({x.id: x.explanation for x in r.RULES})
    return F.transform(flags, lambda f: F.struct(
        f["id"].alias("id"), F.try_element_at(titles, f["id"]).alias("title"),
        F.try_element_at(texts, f["id"]).alias("explanation"),
        f["severity"].alias("severity"), f["matched"].alias("matched")))


def title_of(rule_id: Column) -> Column:
    return F.try_element_at(literal_map({x.id: x.title for x in r.RULES}), rule_id)


def has_severity(flags: Column, high: bool) -> Column:
    return F.exists(flags, lambda f: f["severity"] == "high" if high else f["severity"] != "high")


def flag_profile(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Messages per rule and severity within each key."""
    rows = explode_rows(flagged, keys, F.col("flags"), None, "f")
    return rows.groupBy(*keys, F.col("f.id").alias("rule"), F.col("f.severity").alias("severity")).agg(
        F.count("*").alias("messages"))


def multi_flag_share(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Messages, flagged messages and messages with two or more flags within each key."""
    n = F.size("flags")
    return flagged.select(*keys, n.alias("_n")).groupBy(*keys).agg(
        F.count("*").alias("messages"), F.count_if(F.col("_n") > 0).alias("flagged"),
        F.count_if(F.col("_n") > 1).alias("multi_flagged"))
