"""Red flags, safe signals, verdicts and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import rule_table
from ..dims import rules as r
from ..functions.rows import explode_rows
from ..operators import flags as fl
from ..operators import reports as rp
from ..operators import safe as sf
from ..operators import verdict as vd
from ..plans.messages import read_table
from . import sql as q
from .base import add, msgs

_FL, _SF, _VD = q.ctes(*q.WITH_FLAGS), q.ctes(*q.WITH_SAFE), q.ctes(*q.WITH_VERDICT)


def _rule(rule_id):
    return lambda s, d: fl.single_rule(msgs(s, d), rule_id).select(
        "msg_id", "severity", F.array_join("matched", "|").alias("matched"))


for _i, _x in enumerate(r.RULES, 1):
    add(f"h{_i}_{_x.id}", _rule(_x.id), q.ctes(*q.MESSAGE_LINKS, q.MK, f"fl AS ({q.rule_sql(_x.id)})") +
        " SELECT msg_id, severity, matched FROM fl")

add("h_all_flags", lambda s, d: explode_rows(
    fl.with_flags(msgs(s, d)), ["msg_id"], F.col("flags"), None, "f").select(
    "msg_id", "f.id", "f.severity", F.array_join("f.matched", "|").alias("matched")),
    _FL + " SELECT msg_id, id, severity, matched FROM fl")
add("h16_flag_profile", lambda s, d: fl.flag_profile(fl.with_flags(msgs(s, d)), ["source"]),
    _FL + " SELECT m.source, fl.id AS rule, fl.severity, count(*) AS messages FROM fl JOIN m USING (msg_id) GROUP BY ALL")
add("h16_multi_flag_share", lambda s, d: fl.multi_flag_share(fl.with_flags(msgs(s, d)), ["category"]),
    _FL + """ SELECT category, count(*) AS messages, count(*) FILTER (n > 0) AS flagged, count(*) FILTER (n > 1) AS multi_flagged
    FROM (SELECT m.msg_id, m.category, count(fl.id) AS n FROM m LEFT JOIN fl USING (msg_id) GROUP BY ALL) GROUP BY category""")


def _signal(signal_id):
    return lambda s, d: sf.single_signal(msgs(s, d), signal_id).select(
        "msg_id", F.array_join("matched", "|").alias("matched"), "own_block")


for _i, _x in enumerate(r.SIGNALS, 1):
    add(f"i{_i}_{_x.id}", _signal(_x.id), q.ctes(*q.MESSAGE_LINKS, q.MK, f"sg AS ({q.signal_sql(_x.id)})") +
        " SELECT msg_id, matched, own_block FROM sg")

add("i9_blockers", lambda s, d: explode_rows(
    vd.with_rules(msgs(s, d)), ["msg_id"], F.col("safe.blocked_by"), None, "b").select("msg_id", "b.kind", F.col("b.text").alias("line")),
    _SF + " SELECT msg_id, kind, line FROM bl")
add("i10_applies", lambda s, d: vd.with_rules(msgs(s, d)).select("msg_id", F.col("safe.applies").alias("applies")),
    _SF + " SELECT msg_id, applies FROM ap")


def judged(spark, sf_dir, reason=False):
    return vd.with_verdict(vd.with_rules(msgs(spark, sf_dir)), with_reason=reason)


add("j1_decide", lambda s, d: judged(s, d).select("msg_id", "branch", "verdict"), _VD + " SELECT msg_id, branch, verdict FROM jd")
add("j2_reasons", lambda s, d: judged(s, d, True).select("msg_id", "verdict_display", "verdict_reason"))
add("j3_compat_fields", lambda s, d: judged(s, d).select(
    "msg_id", "label", "ml_label", "confidence", "spam_probability", "safe_signal_applied"), _VD + """
SELECT msg_id, CASE WHEN verdict = 'spam' OR (verdict = 'unsure' AND p >= 0.5) THEN 'spam' ELSE 'ham' END AS label,
  CASE WHEN p >= 0.5 THEN 'spam' ELSE 'ham' END AS ml_label, round(greatest(p, 1 - p), 4) AS confidence,
  round(p, 4) AS spam_probability, applies AND flags = 0 AS safe_signal_applied FROM jd""")


def _matrices(spark, sf_dir):
    both = judged(spark, sf_dir).select("expected", "verdict", "ml_label")
    return vd.verdict_matrices(both, "expected", {"full": "verdict", "ml": "ml_label"})


_COUNTS = ", ".join(f"count(*) FILTER (v = '{c}') AS {c}" for c in ("ham", "unsure", "spam"))
add("j5_verdict_matrix", _matrices, _VD + f""" SELECT expected, judge, {_COUNTS} FROM (
  SELECT expected, 'full' AS judge, verdict AS v FROM jd
  UNION ALL SELECT expected, 'ml', CASE WHEN p >= 0.5 THEN 'spam' ELSE 'ham' END FROM jd) GROUP BY ALL""")

_ML_OK = "(CASE WHEN p >= 0.5 THEN 'spam' ELSE 'ham' END = expected)"
add("e9_ml_only_probes", lambda s, d: rp.ml_report(msgs(s, d), "category"), q.ctes(q.M) + f"""
SELECT category AS grp, count(*) AS total, count(*) FILTER ({_ML_OK}) AS passed,
  count(*) FILTER (p >= 0.35 AND p < 0.65) AS in_band FROM m GROUP BY category""")
add("k1_probe_report", lambda s, d: rp.probe_report(judged(s, d), "category"), _VD + f"""
SELECT category AS grp, count(*) AS total, count(*) FILTER ({_ML_OK}) AS ml_correct,
  count(*) FILTER (verdict = expected) AS final_correct, count(*) FILTER (verdict = 'unsure') AS final_unsure
FROM jd GROUP BY category""")
add("k2_misses", lambda s, d: rp.miss_list(judged(s, d), ["msg_id"]), _VD + f"""
SELECT jd.msg_id, expected, round(p, 3) AS ml_probability, {_ML_OK} AS ml_correct, verdict AS final_verdict,
  coalesce(f.ids, '') AS red_flags, CASE WHEN applies AND flags = 0 THEN coalesce(s.ids, '') ELSE '' END AS safe_signal
FROM jd LEFT JOIN (SELECT msg_id, string_agg(fl.id, ',' ORDER BY ord) AS ids FROM fl JOIN rn ON fl.id = rn.id GROUP BY 1) f
  ON jd.msg_id = f.msg_id
LEFT JOIN (SELECT msg_id, string_agg(sg.id, ',' ORDER BY ord) AS ids FROM sg JOIN sn ON sg.id = sn.id GROUP BY 1) s
  ON jd.msg_id = s.msg_id
WHERE NOT {_ML_OK} OR verdict <> expected""")
add("k3_category_stats", lambda s, d: rp.category_stats(judged(s, d)), _VD + f"""
SELECT category, total, ml_correct, final_correct, CASE WHEN category = 'gray' THEN 'GRAY' WHEN category = 'genuine' THEN 'SAFE'
  WHEN ml_correct / total >= 1 THEN 'LOW' WHEN ml_correct / total >= 0.75 THEN 'MED'
  WHEN ml_correct / total >= 0.5 THEN 'HIGH' ELSE 'CRIT' END AS level
FROM (SELECT category, count(*) AS total, count(*) FILTER ({_ML_OK}) AS ml_correct,
        count(*) FILTER (verdict = expected) AS final_correct FROM jd GROUP BY category)""")
add("k4_language_codes", lambda s, d: read_table(s, d, "documents").select(
    rp.lang_code(F.col("lang")).alias("code"), rp.lang_code(F.col("source")).alias("other")).groupBy("code", "other").agg(
    F.count("*").alias("n")),
    "SELECT upper(substr(lang, 1, 4)) AS code, upper(substr(source, 1, 4)) AS other, count(*) AS n FROM documents GROUP BY ALL")


def _rule_report(spark, sf_dir):
    counts = fl.flag_profile(fl.with_flags(msgs(spark, sf_dir)), []).groupBy("rule").agg(F.sum("messages").alias("messages"))
    named = rule_table(spark).select(F.col("id").alias("rule"), "title", F.col("severity").alias("base_severity"))
    return named.join(counts, "rule", "left").select("rule", "title", "base_severity", F.coalesce("messages", F.lit(0)).alias("messages"))


add("k5_rule_report", _rule_report, _FL + """
SELECT rn.id AS rule, rn.title, rn.base_severity, count(fl.msg_id) AS messages FROM rn LEFT JOIN fl ON rn.id = fl.id GROUP BY ALL""")
