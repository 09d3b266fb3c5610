"""DuckDB texts of the common tables that the checks are built from.

They state the semantics a second time with other means: joins instead of nested arrays, an edit
distance instead of one-typo patterns, set logic instead of case chains.
"""

from __future__ import annotations

from ..dims import domains as d
from ..dims import rules as r
from ..plans.messages import messages_sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def rex(pattern: str, flags: str = "is") -> str:
    return quoted(f"(?{flags})" + pattern)


def hit(pattern: str, col: str = "text", flags: str = "is") -> str:
    return f"regexp_matches({col}, {rex(pattern, flags)})"


def got(pattern: str, col: str = "text", flags: str = "is") -> str:
    return f"trim(regexp_extract({col}, {rex(pattern, flags)}))"


def pipe(items: str) -> str:
    """Snippet list -> cut to 60, repeats ignoring case dropped, joined with a bar."""
    cut = f"list_transform({items}, lambda x: substr(x, 1, 60))"
    return (f"array_to_string(list_filter({cut}, lambda x, i: "
            f"list_position(list_transform({cut}, lambda y: lower(y)), lower(x)) = i), '|')")


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


M = f"m AS ({messages_sql()})"

# --- links of the message table: at most one per message -------------------------------------------
_SCHEME = r"""(?:https?://|www\.)[^\s<>"'()]+"""
_BARE = rf"""(?:^|[^\w@.-])((?:[a-z0-9@-]+\.)+(?:{d.LINK_TLDS})\b(?:[/:?#][^\s<>"'()]*)?)"""

_SHORT = rf"(?:{d.SHORT_LINK_HOSTS})/\S+"


def link_parts(source: str, id_col: str, text: str) -> str:
    return f"""
SELECT {id_col}, {text} AS text, match, raw, auth,
       CASE WHEN contains(auth, '@') THEN lower(regexp_replace(auth, '@[^@]*$', '')) ELSE '' END AS userinfo,
       regexp_replace(trim(lower(split_part(regexp_replace(auth, '^.*@', ''), ':', 1)), '.'), '^www\\.', '') AS host
FROM (SELECT *, regexp_extract(regexp_replace(raw, '(?i)^https?://', ''), '^[^/?#\\\\]*') AS auth
      FROM (SELECT *, rtrim(match, {quoted(d.LINK_TAIL)}) AS raw
            FROM (SELECT {id_col}, {text}, coalesce(nullif(regexp_extract({text}, {rex(_SCHEME, 'i')}), ''),
                                   nullif(regexp_extract({text}, {rex(_BARE, 'i')}, 1), ''),
                                   nullif(regexp_extract({text}, {rex(_SHORT, 'i')}), '')) AS match
                  FROM {source}) WHERE match IS NOT NULL))"""


_ALLOW = "allow AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(v)})" for k, v in d.OFFICIAL.items()) + ") AS a(domain, owner))"
_BRANDS = "brands AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(n)}, {quoted(p)})" for i, (n, p, _) in enumerate(d.HOST_BRANDS)) + ") AS b(bord, brand, host_re))"
_WORDS = "typo_words AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(n)}, {quoted(w)})" for i, (n, _, ws) in enumerate(d.HOST_BRANDS) for w in ws) + ") AS w(bord, brand, word))"


def tokens_of(source: str, host: str = "host") -> str:
    """(host, tord, token): labels without the public suffix, whole and in hyphen pieces."""
    return f"""
SELECT {host} AS host, tord, token FROM (
  SELECT {host}, unnest(toks) AS token, generate_subscripts(toks, 1) AS tord FROM (
    SELECT {host}, list_filter(flatten(list_transform(kept, lambda l: list_concat([l],
             list_filter(string_split(l, '-'), lambda p: p <> l)))), lambda t: t <> '') AS toks
    FROM (SELECT {host}, CASE WHEN len(labels) > cut THEN labels[1:len(labels) - cut] ELSE labels END AS kept
          FROM (SELECT {host}, string_split({host}, '.') AS labels,
                       CASE WHEN len(string_split({host}, '.')) >= 3
                             AND array_to_string(string_split({host}, '.')[-2:], '.') IN {names(d.TWO_LEVEL)}
                            THEN 2 ELSE 1 END AS cut FROM {source}))))"""


def variants_of(tokens: str) -> str:
    """(host, tord, vord, variant) in report order, repeats included."""
    digits = f"translate(token, '{d.HOMOGLYPH_FROM}', '{d.HOMOGLYPH_TO}')"
    l_form = (f"translate(translate(token, '{d.L_FORM_FROM}', '{d.L_FORM_TO}'), "
              f"'{d.HOMOGLYPH_FROM}', '{d.HOMOGLYPH_TO}')")

    def merged(e: str) -> str:
        return f"replace(replace({e}, 'rn', 'm'), 'vv', 'w')"

    forms = [f for f in ("token", digits, l_form)]
    forms += [merged(f) for f in forms]
    return " UNION ALL ".join(
        f"SELECT host, tord, {i} AS vord, {f} AS variant FROM {tokens}" for i, f in enumerate(forms))


def brand_ctes(source: str, prefix: str = "") -> list[str]:
    """CTEs ending in ``{prefix}brand_of(host, brand)`` for the hosts of ``source``."""
    p = prefix
    return [
        f"{p}toks AS ({tokens_of(source)})",
        f"{p}vars AS ({variants_of(p + 'toks')})",
        f"""{p}wins AS (
  SELECT v.host, v.tord, v.vord, w.bord, w.brand FROM (SELECT DISTINCT host, tord, vord, variant,
         unnest(range(1, length(variant) + 1)) AS i FROM {p}vars) v
  JOIN typo_words w ON damerau_levenshtein(substr(v.variant, v.i, length(w.word) - 1), w.word) <= 1
    OR damerau_levenshtein(substr(v.variant, v.i, length(w.word)), w.word) <= 1
    OR damerau_levenshtein(substr(v.variant, v.i, length(w.word) + 1), w.word) <= 1)""",
        f"""{p}brand_of AS (SELECT host, arg_min(brand, tord * 1000000 + vord * 1000 + bord) AS brand FROM (
  SELECT host, tord, vord, bord, brand FROM {p}wins
  UNION ALL SELECT v.host, v.tord, v.vord, b.bord, b.brand FROM {p}vars v JOIN brands b
    ON regexp_matches(v.variant, b.host_re)) GROUP BY host)""",
    ]


def owner_ctes(source: str, prefix: str = "") -> list[str]:
    return [f"""{prefix}owner_of AS (SELECT h.host, arg_max(a.owner, length(a.domain)) AS owner
  FROM (SELECT DISTINCT host FROM {source}) h JOIN allow a ON h.host = a.domain OR h.host LIKE '%.' || a.domain
  GROUP BY h.host)"""]


def registrable(host: str) -> str:
    parts = f"string_split({host}, '.')"
    return (f"array_to_string({parts}[CASE WHEN len({parts}) >= 3 AND array_to_string({parts}[-2:], '.') IN "
            f"{names(d.TWO_LEVEL)} THEN -3 ELSE -2 END:], '.')")


NEUTRAL_TEST = "(host IN {n} OR {s})".format(n=names(d.NEUTRAL), s=" OR ".join(
    f"host = '{x}' OR host LIKE '%.{x}'" for x in d.NEUTRAL_SUFFIXES))

DIMS = [_ALLOW, _BRANDS, _WORDS]


def classified(source: str = "lk") -> list[str]:
    """CTEs ending in ``kd``: the links of ``source`` with kind, owner and brand."""
    return [
        *DIMS,
        f"hs AS (SELECT DISTINCT host FROM {source})",
        f"us AS (SELECT DISTINCT replace(userinfo, '@', '.') || '.x' AS host FROM {source} WHERE userinfo <> '')",
        *owner_ctes("hs"), *brand_ctes("hs"), *brand_ctes("us", "u"),
        f"""kd AS (SELECT l.*, o.owner IS NOT NULL AS official_host,
  CASE WHEN u.brand IS NOT NULL THEN 'lookalike' WHEN o.owner IS NOT NULL THEN 'official'
       WHEN l.host IN {names(d.SHORTENERS)} THEN 'shortener' WHEN {NEUTRAL_TEST.replace('host', 'l.host')} THEN 'neutral'
       WHEN b.brand IS NOT NULL THEN 'lookalike' ELSE 'other' END AS kind,
  CASE WHEN u.brand IS NULL AND o.owner IS NOT NULL THEN o.owner
       WHEN u.brand IS NULL AND (l.host IN {names(d.SHORTENERS)} OR {NEUTRAL_TEST.replace('host', 'l.host')}) THEN NULL
       ELSE {registrable('l.host')} END AS owner,
  CASE WHEN u.brand IS NOT NULL THEN u.brand WHEN o.owner IS NULL AND l.host NOT IN {names(d.SHORTENERS)}
        AND NOT {NEUTRAL_TEST.replace('host', 'l.host')} THEN b.brand END AS brand
  FROM {source} l LEFT JOIN owner_of o ON l.host = o.host LEFT JOIN brand_of b ON l.host = b.host
  LEFT JOIN ubrand_of u ON replace(l.userinfo, '@', '.') || '.x' = u.host AND l.userinfo <> '')""",
    ]


LK = f"lk AS (SELECT * FROM ({link_parts('m', 'msg_id', 'text')}) WHERE contains(host, '.'))"
MESSAGE_LINKS = [M, LK, *classified()]
# messages with their link, if any, and their text without official links
MK = """mk AS (SELECT m.*, k.raw, k.host, k.userinfo, k.kind, k.owner, k.brand, k.official_host,
  CASE WHEN k.kind = 'official' THEN replace(m.text, k.match, 'officialsite') ELSE m.text END AS masked
  FROM m LEFT JOIN kd k ON m.msg_id = k.msg_id)"""


def text_brands(col: str) -> str:
    cases = ", ".join(f"CASE WHEN {hit(p, col, 'i')} THEN {quoted(n)} END" for n, p in d.TEXT_BRANDS)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_OTP_PLAIN = r.RULE_BY_ID["otp_request"].groups[0].split(r"(?<!mat )")[1]
_OTP_NEGATED = r"(?:not|never|n't|mat) (?:share|tell|give|batao|bataye|bataen|send)\b"


def rule_sql(rule_id: str) -> str:
    """(msg_id, id, severity, matched) of one rule over ``mk``."""
    rule = r.RULE_BY_ID[rule_id]

    def row(severity: str, items: str, where: str) -> str:
        return (f"SELECT msg_id, '{rule_id}' AS id, {severity} AS severity, {pipe(items)} AS matched "
                f"FROM mk WHERE {where}")

    if rule_id == "kyc_block":
        ok = f"(coalesce(kind = 'official', false) AND NOT {hit(r.PHONE)})"
        a = " AND ".join(hit(p) for p in (r.KYC_ENTITY, r.KYC_BLOCKISH, r.CALL_OR_LINK))
        b = f"{hit(r.KYC_THREAT)} AND {hit(r.KYC_DEMAND)}"
        linked, note = hit(r.KYC_LINK_OR_NUMBER), quoted(r.KYC_OFFICIAL_NOTE)
        first = f"[{got(r.KYC_ENTITY)}, {got(r.KYC_BLOCKISH)}, {got(r.CALL_OR_LINK)}]"
        second = f"[{got(r.KYC_THREAT)}, {got(r.KYC_DEMAND)}]"
        items = (f"CASE WHEN {a} THEN list_concat({first}, CASE WHEN {ok} THEN [{note}] ELSE [] END) "
                 f"ELSE list_concat({second}, CASE WHEN {linked} AND {ok} THEN [{note}] "
                 f"WHEN {linked} THEN [{got(r.KYC_LINK_OR_NUMBER)}] ELSE [] END) END")
        severity = f"CASE WHEN {ok} THEN 'medium' WHEN ({a}) OR {linked} THEN 'high' ELSE 'medium' END"
        return row(severity, items, f"({a}) OR (({b}) AND ({linked} OR NOT {hit(r.KYC_BRANCH)}))")
    if rule_id == "prize_claim":
        items = (f"CASE WHEN {hit(r.PRIZE_STRONG)} THEN [{got(r.PRIZE_STRONG)}] "
                 f"ELSE [{got(r.PRIZE_WIN)}, {got(r.PRIZE_WHAT)}] END")
        return row("'high'", items, f"{hit(r.PRIZE_STRONG)} OR ({hit(r.PRIZE_WIN)} AND {hit(r.PRIZE_WHAT)})")
    if rule_id == "otp_request":
        return row("'high'", f"[{got(_OTP_PLAIN)}]", f"{hit(_OTP_PLAIN)} AND NOT {hit(_OTP_NEGATED)}")
    if rule_id == "lookalike_domain":
        items = ("list_concat([CASE WHEN userinfo = '' THEN host ELSE raw END, 'imitates ' || coalesce(brand, 'None')], "
                 "CASE WHEN owner <> host THEN ['real owner: ' || owner] ELSE [] END)")
        return row("'high'", items, "kind = 'lookalike'")
    if rule_id == "brand_link_mismatch":
        window = ("substr(text, greatest(instr(text, raw) - 200, 1), instr(text, raw) - "
                  "greatest(instr(text, raw) - 200, 1) + length(raw) + 60)")
        items = (f"list_concat(list_transform(({text_brands('win')})[1:2], lambda b: 'mentions ' || b), "
                 "['link goes to ' || host || CASE WHEN kind = 'shortener' THEN ' (URL shortener)' ELSE '' END])")
        return (f"SELECT msg_id, '{rule_id}' AS id, 'medium' AS severity, {pipe(items)} AS matched "
                f"FROM (SELECT *, {window} AS win FROM mk WHERE kind IN ('shortener', 'other')) "
                f"WHERE len({text_brands('win')}) > 0 AND {hit(r.ACTION, 'win')}")
    if rule_id == "suspicious_link":
        p = rule.groups[0]
        return row("'medium'", f"[{got(p, 'masked')}]", hit(p, "masked"))
    return row(quoted(rule.severity), "[" + ", ".join(got(g) for g in rule.groups) + "]",
               " AND ".join(hit(g) for g in rule.groups))


FLAGS = "fl AS (" + " UNION ALL ".join(rule_sql(x.id) for x in r.RULES) + ")"
TITLES = ", ".join(f"({i}, {quoted(x.id)}, {quoted(x.title)}, {quoted(x.severity)})" for i, x in enumerate(r.RULES))
RULE_NAMES = f"rn AS (SELECT * FROM (VALUES {TITLES}) AS t(ord, id, title, base_severity))"
SIGNAL_NAMES = "sn AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(x.id)}, {quoted(x.title)})" for i, x in enumerate(r.SIGNALS)) + ") AS t(ord, id, title))"

_MOBILE = r"(?:^|[^\d])((?:\+?91[\s-]?)?[6-9][\dXx]{4}[\s-]?[\dXx]{5})(?:$|[^\d])"


def signal_sql(signal_id: str) -> str:
    """(msg_id, id, matched, own_block) of one signal over ``mk``."""
    sig = r.SIGNAL_BY_ID[signal_id]
    if signal_id == "official_link":
        own = (f"CASE WHEN {hit(_MOBILE)} THEN 'also gives a mobile number (''' || regexp_extract(text, {rex(_MOBILE)}, 1) "
               "|| '''); real alerts use toll-free/official numbers' END")
        return (f"SELECT msg_id, 'official_link' AS id, substr(host || ' (' || split_part(owner, ' (', 1) || ')', 1, 60) "
                f"AS matched, {own} AS own_block FROM mk WHERE kind = 'official'")
    own = "CAST(NULL AS VARCHAR)"
    if signal_id == "otp_notice":
        own = ("CASE WHEN coalesce(kind <> 'official', false) THEN 'OTP messages should not contain links (other than "
               "the bank''s official domain), and this one does' END")
    elif sig.own_block:
        own = (f"CASE WHEN {hit(sig.own_block)} THEN 'also contains ''' || {got(sig.own_block)} "
               "|| ''', which genuine notices of this type don''t' END")
    items = " || '|' || ".join(f"substr({got(g)}, 1, 60)" for g in sig.groups)
    return (f"SELECT msg_id, '{signal_id}' AS id, {items} AS matched, {own} AS own_block FROM mk WHERE "
            + " AND ".join(hit(g) for g in sig.groups))


SIGNALS = "sg AS (" + " UNION ALL ".join(signal_sql(x.id) for x in r.SIGNALS) + ")"

_CRED = got(r.CREDENTIALS, flags="i")
BLOCKS = f"""bl AS (
  SELECT msg_id, b.ord, b.kind, b.line FROM (
    SELECT f.msg_id, n.ord AS ord, 'flag' AS kind, 'red flag fired: ' || n.title AS line FROM fl f JOIN rn n ON f.id = n.id
    UNION ALL SELECT msg_id, 100, 'host', 'contains a link to a non-official domain (' || host || ')' FROM mk
      WHERE NOT official_host
    UNION ALL SELECT msg_id, 101, 'shortener', 'uses a shortened link that hides the real destination' FROM mk
      WHERE {hit(r.SHORTENER_LINK, flags='i')}
    UNION ALL SELECT msg_id, 102, 'credentials', 'asks for a PIN/OTP/password/card details (''' || substr(cand, 1, 50) || ''')'
      FROM (SELECT msg_id, text, {_CRED} AS cand FROM mk) WHERE cand <> ''
        AND NOT regexp_matches(right(substr(text, 1, instr(text, cand) - 1), 25), {rex(r.NEGATED_BEFORE, 'i')})
    UNION ALL SELECT msg_id, 103, 'payment', 'asks for a payment or fee (''' || {got(r.PAYMENT)} || ''')' FROM mk
      WHERE {hit(r.PAYMENT)} AND msg_id NOT IN (SELECT msg_id FROM sg WHERE id = 'echallan_official')
    UNION ALL SELECT msg_id, 104, 'urge', 'urges you to call a number to avoid blocking (''' ||
        substr({got(r.CALL_TO_AVOID)}, 1, 50) || ''')' FROM mk WHERE {hit(r.CALL_TO_AVOID)}
    UNION ALL SELECT s.msg_id, 200 + n.ord, 'own', n.title || ': ' || s.own_block FROM sg s JOIN sn n ON s.id = n.id
      WHERE s.own_block IS NOT NULL) b
  WHERE msg_id IN (SELECT msg_id FROM sg))"""
APPLIES = """ap AS (SELECT m.msg_id, coalesce(s.clean > 0, false) AND coalesce(b.hard, 0) = 0 AS applies,
    coalesce(s.official, 0) > 0 AS official, coalesce(s.formats, 0) > 0 AS formats
  FROM m LEFT JOIN (SELECT msg_id, count(*) FILTER (own_block IS NULL) AS clean,
      count(*) FILTER (own_block IS NULL AND id = 'official_link') AS official,
      count(*) FILTER (own_block IS NULL AND id <> 'official_link') AS formats FROM sg GROUP BY msg_id) s USING (msg_id)
  LEFT JOIN (SELECT msg_id, count(*) FILTER (kind <> 'own') AS hard FROM bl GROUP BY msg_id) b USING (msg_id))"""
VERDICTS = """vd AS (SELECT m.msg_id, m.expected, m.category, m.source, m.p, flags, high, medium, applies,
    CASE WHEN flags = 0 AND applies AND official AND formats THEN 'both'
         WHEN flags = 0 AND applies AND official THEN CASE WHEN p >= 0.95 THEN 'official_sure' ELSE 'official' END
         WHEN flags = 0 AND applies THEN CASE WHEN p >= 0.95 THEN 'format_sure' WHEN p >= 0.35 THEN 'format_mid'
              ELSE 'format_low' END
         WHEN p >= 0.65 THEN 'ml_spam' WHEN high > 0 THEN 'high'
         WHEN p >= 0.35 THEN CASE WHEN medium > 0 THEN 'medium_mid' ELSE 'mid' END
         WHEN medium > 0 THEN 'medium_low' ELSE 'clear' END AS branch
  FROM m JOIN ap USING (msg_id) JOIN (SELECT m.msg_id, count(f.id) AS flags, count(f.id) FILTER (f.severity = 'high') AS high,
      count(f.id) FILTER (f.severity <> 'high') AS medium FROM m LEFT JOIN fl f ON m.msg_id = f.msg_id GROUP BY m.msg_id)
    USING (msg_id)),
jd AS (SELECT *, CASE WHEN branch IN ('both', 'official', 'format_mid', 'format_low', 'clear') THEN 'ham'
    WHEN branch IN ('ml_spam', 'high', 'medium_mid') THEN 'spam' ELSE 'unsure' END AS verdict FROM vd)"""

WITH_FLAGS = [*MESSAGE_LINKS, MK, FLAGS, RULE_NAMES]
WITH_SAFE = [*WITH_FLAGS, SIGNAL_NAMES, SIGNALS, BLOCKS, APPLIES]
WITH_VERDICT = [*WITH_SAFE, VERDICTS]
