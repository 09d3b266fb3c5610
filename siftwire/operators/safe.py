"""Safe-alert signals, their blockers, and whether they apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import rules as r
from ..functions import rx
from ..functions.match import SNIPPET_CHARS, Message, all_of, first, has, literal_map
from ..functions.rows import bound, with_compact
from .flags import title_of, with_needles

SIGNALS_TYPE = "array<struct<id:string,matched:array<string>,own_block:string>>"
SAFE_TYPE = (
    f"struct<applies:boolean,signals:{SIGNALS_TYPE},"
    "blocked_by:array<struct<kind:string,text:string>>>"
)


def _quoted(before: str, quote: Column, after: str) -> Column:
    return F.concat(F.lit(before), quote, F.lit(after))


def _signal(signal_id: str, matched: Column, own_block: Column) -> Column:
    return F.struct(F.lit(signal_id).alias("id"), matched.alias("matched"), own_block.alias("own_block"))


def _official_link(text: Message, links: Column) -> Column:
    good = (F.size(links) > 0) & F.forall(links, lambda x: x["kind"] == "official")
    names = F.transform(F.slice(links, F.lit(1), F.lit(3)), lambda x: F.substring(F.concat(
        x["host"], F.lit(" ("), F.substring_index(x["owner"], " (", 1), F.lit(")")), 1, SNIPPET_CHARS))
    own = F.when(has(text, r.MOBILE), _quoted(
        "also gives a mobile number ('", first(text, r.MOBILE), "'); real alerts use toll-free/official numbers"))
    return F.when(good, _signal("official_link", names, own))


def _format_signal(sig: r.Signal, text: Message, links: Column) -> Column:
    own = F.lit(None).cast("string")
    if sig.id == "otp_notice":
        own = F.when(F.exists(links, lambda x: x["kind"] != "official"), F.lit(
            "OTP messages should not contain links (other than the bank's official domain), and this one does"))
    elif sig.own_block:
        own = F.when(has(text, sig.own_block), _quoted(
            "also contains '", first(text, sig.own_block), "', which genuine notices of this type don't"))
    matched = F.array(*[F.substring(first(text, g), 1, SNIPPET_CHARS) for g in sig.groups])
    return F.when(all_of(text, sig.groups), _signal(sig.id, matched, own))


def signal_column(signal_id: str, text: Message, links: Column) -> Column:
    """``struct<id, matched, own_block>`` where the signal is present, else NULL."""
    if signal_id == "official_link":
        return _official_link(text, links)
    return _format_signal(r.SIGNAL_BY_ID[signal_id], text, links)


def credential_request(text: Message) -> Column:
    """First request for a PIN, OTP, password or card that is not negated just before, else NULL.

    The text is cut at the requests; the characters before each one are put together again from
    the pieces in front of it (a request is at least eight characters, so five pieces cover the
    negation window).
    """
    pattern = rx.java(r.CREDENTIALS, "i")
    negated = rx.java(r.NEGATED_BEFORE.removesuffix("$"), "i") + r"\z"

    def pick(found: Column) -> Column:
        def clear(pieces: Column) -> Column:
            woven = F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))

            def before(w: Column, k: Column) -> Column:
                low = F.greatest(k - 4, F.lit(1))
                return F.right(F.concat(
                    F.array_join(F.slice(w, low, F.least(k, F.lit(4))), ""), F.get(pieces, k)), F.lit(r.NEGATION_WINDOW))

            return bound(woven, lambda w: F.filter(
                found, lambda m, k: ~F.rlike(before(w, k), F.lit(negated))))

        return bound(F.split(text.column, pattern), clear)

    asked = bound(F.regexp_extract_all(text.column, F.lit(pattern), F.lit(0)), pick)
    return F.when(has(text, r.CREDENTIALS, "i"), F.get(asked, F.lit(0)))


def _blockers(text: Message, links: Column, flags: Column, signals: Column) -> Column:
    def block(kind: str, line: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), line.alias("text"))

    by_flag = F.transform(flags, lambda f: block("flag", F.concat(F.lit("red flag fired: "), title_of(f["id"]))))
    strangers = F.array_sort(F.array_distinct(F.transform(
        F.filter(links, lambda x: ~x["official_host"]), lambda x: x["host"])))
    host = F.when(F.exists(links, lambda x: ~x["official_host"]), block("host", _quoted(
        "contains a link to a non-official domain (",
        F.array_join(F.slice(strangers, F.lit(1), F.lit(3)), ", "), ")")))
    short = F.when(has(text, r.SHORTENER_LINK, "i"), block(
        "shortener", F.lit("uses a shortened link that hides the real destination")))
    asks = bound(credential_request(text), lambda c: F.when(c.isNotNull(), block("credentials", _quoted(
        "asks for a PIN/OTP/password/card details ('", F.substring(c, 1, 50), "')"))))
    pays = F.when(
        has(text, r.PAYMENT) & ~F.exists(signals, lambda s: s["id"] == "echallan_official"),
        block("payment", _quoted("asks for a payment or fee ('", first(text, r.PAYMENT), "')")))
    urges = F.when(has(text, r.CALL_TO_AVOID), block("urge", _quoted(
        "urges you to call a number to avoid blocking ('", F.substring(first(text, r.CALL_TO_AVOID), 1, 50), "')")))
    titles = literal_map({s.id: s.title for s in r.SIGNALS})
    own = F.transform(F.filter(signals, lambda s: s["own_block"].isNotNull()), lambda s: block(
        "own", F.concat(F.try_element_at(titles, s["id"]), F.lit(": "), s["own_block"])))
    return F.concat(by_flag, F.array_compact(F.array(host, short, asks, pays, urges)), own)


def with_safe(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``safe``: applies, signals, blocked_by.  Needs ``links`` and ``flags``."""
    keep = [*df.columns, "safe"]
    df = with_needles(df, text)
    t, links = Message(text, needles="_needles"), F.col("links")
    df = with_compact(df, "_signals", [signal_column(s.id, t, links) for s in r.SIGNALS], SIGNALS_TYPE)
    blocks = F.when(F.size("_signals") > 0, _blockers(t, links, F.col("flags"), F.col("_signals"))).otherwise(
        F.array().cast("array<struct<kind:string,text:string>>"))
    df = df.withColumn("_blocks", blocks)
    applies = (
        F.exists("_signals", lambda s: s["own_block"].isNull())
        & ~F.exists("_blocks", lambda b: b["kind"] != "own"))
    return df.withColumn("safe", F.struct(
        applies.alias("applies"), F.col("_signals").alias("signals"), F.col("_blocks").alias("blocked_by"))
    ).select(*keep)


def single_signal(df: DataFrame, signal_id: str, id_col: str = "msg_id", text: str = "text") -> DataFrame:
    """Messages that carry one signal, with its snippets and its own block."""
    from ..functions.rows import explode_rows
    from .links import with_links

    linked = with_links(with_needles(df.select(id_col, text), text), text)
    msg = Message(text, needles="_needles")
    found = linked.select(id_col, signal_column(signal_id, msg, F.col("links")).alias("_s"))
    rows = explode_rows(found, [id_col], F.array_compact(F.array("_s")), None, "s")
    return rows.select(id_col, F.col("s.matched").alias("matched"), F.col("s.own_block").alias("own_block"))


def display_signals(signals: Column) -> Column:
    titles = literal_map({x.id: x.title for x in r.SIGNALS})
    texts = literal_map({x.id: x.explanation for x in r.SIGNALS})
    return F.transform(signals, lambda s: F.struct(
        s["id"].alias("id"), F.try_element_at(titles, s["id"]).alias("title"),
        F.try_element_at(texts, s["id"]).alias("explanation"), s["matched"].alias("matched"),
        s["own_block"].alias("rule_specific_block")))
