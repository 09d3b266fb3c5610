"""Three-way verdict from probability, flags and safe signals, with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import rules as r
from ..functions.match import literal_map
from .flags import display_flags, has_severity, title_of, with_flags, with_needles
from .links import with_links
from .safe import display_signals, with_safe

# --- fixed values: decision thresholds -----------------------------------------------------------
UNSURE_LOW, UNSURE_HIGH = 0.35, 0.65
SURE = 0.95
SPAM_AT = 0.5

# --- fixed values: wording of reasons and titles, by branch -----------------------------------------
REASONS = {
    "both": "ML score was {pct}, but the message matches a standard alert format ({formats}), its link goes only to an "
            "official domain ({hosts}), and no red flags were found. Two independent good signs, so it is treated as "
            "Not spam even if the ML model is very confident. Never share OTP/PIN.",
    "official_sure": "ML model says spam ({pct}), but every link goes to an official domain ({hosts}) and no red flags "
                     "were found. ML is very confident and the message doesn't match a known alert format, so it is "
                     "marked Unsure. Open the organisation's app or type its address yourself.",
    "official": "ML score is {pct}, but every link goes to an official domain ({hosts}), and there is no red flag, "
                "mobile number, payment or PIN/OTP request, so it is treated as Not spam.",
    "format_sure": "ML model says spam ({pct}), but the message matches a standard alert format ({names}) and no red "
                   "flags were found. ML is very confident, so it is marked Unsure, not Not spam. Check the sender "
                   "before acting.",
    "format_mid": "ML score was {pct}, but the message matches a standard alert format ({names}) and no red flags were "
                  "found, so it is treated as Not spam. Scammers can copy this format; never share OTP/PIN or pay via "
                  "links.",
    "format_low": "ML model says not spam ({pct}), no red flags were found, and the message matches a standard alert "
                  "format ({names}).",
    "ml_spam": "ML model is confident this is spam ({pct} spam probability){also}{unapplied}.",
    "high": "Red-flag rule fired ({high}). High-severity rules override the ML score, which was {pct}.",
    "medium_mid": "ML score is borderline ({pct}) and a red flag was found ({medium}), so it is treated as spam.",
    "mid": "ML score is borderline ({pct}) and no red flags were found. Use your judgement.{unapplied_mid}",
    "medium_low": "ML model leans not-spam ({pct}) but a red flag was found ({medium}). Be careful.",
    "clear": "ML model says not spam ({pct} spam probability) and no red flags were found.",
}
TITLES = {
    "both": "Not spam (standard alert + official link)",
    "official_sure": "Unsure (official link)",
    "official": "Not spam (official link)",
    "format_sure": "Unsure (looks like a standard alert)",
    "format_mid": "Not spam (standard alert)",
    "format_low": "Not spam (standard alert)",
}
VERDICT_OF = {
    "both": "ham", "official_sure": "unsure", "official": "ham", "format_sure": "unsure", "format_mid": "ham",
    "format_low": "ham", "ml_spam": "spam", "high": "spam", "medium_mid": "spam", "mid": "unsure",
    "medium_low": "unsure", "clear": "ham",
}
DISPLAY = {"spam": "Spam", "ham": "Not spam", "unsure": "Unsure"}


def branch(p: Column, flags: Column, safe: Column) -> Column:
    """Name of the first decision branch that holds."""
    clean = F.filter(safe["signals"], lambda s: s["own_block"].isNull())
    official = F.exists(clean, lambda s: s["id"] == "official_link")
    formats = F.exists(clean, lambda s: s["id"] != "official_link")
    calm = (F.size(flags) == 0) & safe["applies"]
    medium = has_severity(flags, high=False)
    return (
        F.when(calm & official & formats, "both")
        .when(calm & official & (p >= SURE), "official_sure")
        .when(calm & official, "official")
        .when(calm & (p >= SURE), "format_sure")
        .when(calm & (p >= UNSURE_LOW), "format_mid")
        .when(calm, "format_low")
        .when(p >= UNSURE_HIGH, "ml_spam")
        .when(has_severity(flags, high=True), "high")
        .when(medium & (p >= UNSURE_LOW), "medium_mid")
        .when(p >= UNSURE_LOW, "mid")
        .when(medium, "medium_low")
        .otherwise("clear"))


def percent(p: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(p * 100, 0).cast("long").cast("string"), F.lit("%"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{name}`` holes -> one concat."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def reason(branch_col: Column, p: Column, flags: Column, safe: Column) -> Column:
    titles = literal_map({s.id: s.title for s in r.SIGNALS})
    clean = F.filter(safe["signals"], lambda s: s["own_block"].isNull())

    def title_list(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.try_element_at(titles, s["id"])), ", ")

    blocked = F.array_join(F.transform(safe["blocked_by"], lambda b: b["text"]), "; ")
    unapplied = F.when(F.size(safe["signals"]) > 0, F.concat(
        F.lit(". A standard-alert format was detected but not applied ("), blocked, F.lit(")"))).otherwise("")
    values = {
        "pct": percent(p),
        "names": title_list(clean),
        "formats": title_list(F.filter(clean, lambda s: s["id"] != "official_link")),
        "hosts": F.array_join(F.transform(
            F.flatten(F.transform(F.filter(clean, lambda s: s["id"] == "official_link"), lambda s: s["matched"])),
            lambda m: F.substring_index(m, " (", 1)), ", "),
        "high": F.array_join(F.transform(
            F.filter(flags, lambda f: f["severity"] == "high"), lambda f: title_of(f["id"])), ", "),
        "medium": title_of(F.get(F.filter(flags, lambda f: f["severity"] != "high"), F.lit(0))["id"]),
        "also": F.when(F.size(flags) > 0, F.concat(
            F.lit(", and "), F.size(flags).cast("string"), F.lit(" red-flag rule(s) also fired"))).otherwise(""),
        "unapplied": unapplied,
        "unapplied_mid": F.when(F.size(safe["signals"]) > 0, F.concat(
            F.lit(" A standard-alert format was detected but not applied ("), blocked, F.lit(")."))).otherwise(""),
    }
    out = F.lit(None).cast("string")
    for name, template in reversed(REASONS.items()):
        out = F.when(branch_col == name, _fill(template, values)).otherwise(out)
    return out


def with_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Links, flags and safe signals of every message; no shuffle."""
    keep = [*df.columns, "link_spans", "links", "flags", "safe"]
    return with_safe(with_flags(with_links(with_needles(df, text), text), text), text).select(*keep)


def with_verdict(df: DataFrame, probability: str = "p", with_reason: bool = True) -> DataFrame:
    """Add the verdict fields to rows that carry a probability, ``flags`` and ``safe``."""
    p, flags, safe = F.col(probability), F.col("flags"), F.col("safe")
    df = df.withColumn("branch", branch(p, flags, safe))
    verdict = F.try_element_at(literal_map(VERDICT_OF), F.col("branch"))
    df = df.withColumn("verdict", verdict)
    title = F.coalesce(F.try_element_at(literal_map(TITLES), F.col("branch")),
                       F.try_element_at(literal_map(DISPLAY), F.col("verdict")))
    ml = F.when(p >= SPAM_AT, "spam").otherwise("ham")
    label = F.when((F.col("verdict") == "spam") | ((F.col("verdict") == "unsure") & (p >= SPAM_AT)), "spam").otherwise("ham")
    df = df.withColumns({
        "ml_label": ml, "label": label, "spam_probability": F.round(p, 4),
        "confidence": F.round(F.when(p >= SPAM_AT, p).otherwise(1 - p), 4),
        "verdict_display": title,
        "safe_signal_applied": safe["applies"] & (F.size(flags) == 0),
    })
    if with_reason:
        df = df.withColumn("verdict_reason", reason(F.col("branch"), p, flags, safe))
    return df


def prediction_record(df: DataFrame, keys: list[str]) -> DataFrame:
    """The display record of a judged message table."""
    return df.select(
        *keys, "label", "spam_probability", "confidence", "verdict", "verdict_reason", "ml_label", "verdict_display",
        display_flags(F.col("flags")).alias("red_flags"),
        display_signals(F.col("safe.signals")).alias("safe_signals"), "safe_signal_applied",
        F.transform("safe.blocked_by", lambda b: b["text"]).alias("safe_signal_blocked_by"))


def verdict_matrix(judged: DataFrame, truth: str, call: str) -> DataFrame:
    """True label against ham / unsure / spam counts."""
    wide = judged.groupBy(truth).pivot(call, ["ham", "unsure", "spam"]).count()
    return wide.select(truth, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("ham", "unsure", "spam")])


def verdict_matrices(judged: DataFrame, truth: str, calls: dict[str, str]) -> DataFrame:
    """``verdict_matrix`` of several judges, ``calls`` by name, from one pass over the judged rows."""
    counts = judged.groupBy(truth, *dict.fromkeys(calls.values())).agg(F.count("*").alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("judge"), F.col(c).alias("call")) for name, c in calls.items()]))
    rows = counts.select(truth, "_n", each.alias("_c")).select(truth, "_n", "_c.judge", "_c.call")
    wide = rows.groupBy(truth, "judge").pivot("call", ["ham", "unsure", "spam"]).agg(F.sum("_n"))
    return wide.select(truth, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("ham", "unsure", "spam")], "judge")
