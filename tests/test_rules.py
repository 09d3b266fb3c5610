"""Links, flags, safe signals and verdicts: own cases, properties and plan checks."""

import re

import pytest
from pyspark.sql import functions as F

from siftwire.dims import rules as r
from siftwire.functions import hosts as h
from siftwire.operators import links as ln
from siftwire.operators import verdict as vd
from siftwire.plans.messages import TEMPLATES, messages

SF = "/root/testdata/sf0.001"

KINDS = [
    ("https://login.axisbank.com/a", "official"), ("KOTAK.COM", "official"), ("x.y.gov.in", "official"),
    ("pay.google.com/x", "official"), ("mail.google.com", "other"), ("axisbank.com.bad.top", "lookalike"),
    ("axis-kyc.net", "lookalike"), ("kotakbnak.com", "lookalike"), ("p4ytm.shop", "lookalike"), ("f1ipkart.in", "lookalike"),
    ("http://icicibank.com@bad.top/x", "lookalike"), ("www.arnazon.net", "lookalike"), ("praxis.org", "other"),
    ("s3.amazonaws.com/b", "neutral"), ("fkrt.it/abc", "neutral"), ("tinyurl.com/q", "shortener"), ("is.gd/1", "shortener"),
    ("nothing here", "none"), ("rbi.org.in.fake.com", "lookalike"), ("gov.in.fake.com", "other"),
]

# template number -> rules that must fire on it
FIRES = {
    0: {"upi_pin_receive"}, 1: {"kyc_block"}, 2: {"kyc_block"}, 3: {"kyc_block"}, 4: set(), 5: {"parcel_fee"},
    6: {"arrest_payment"}, 7: {"fake_customer_care", "otp_request"}, 8: {"urgent_wire_transfer"},
    9: {"job_fee", "prize_claim"}, 10: {"emergency_money"}, 11: {"utility_disconnect"}, 12: {"extortion_threat"},
    13: {"prize_claim"}, 14: {"prize_claim"}, 15: {"otp_request"}, 16: set(), 17: {"lookalike_domain", "suspicious_link"},
    19: {"lookalike_domain"}, 20: {"lookalike_domain"}, 21: {"brand_link_mismatch", "suspicious_link"},
    22: {"brand_link_mismatch", "suspicious_link"}, 23: {"suspicious_link"}, 24: set(), 38: {"kyc_block"},
    39: {"emergency_money"}, 40: set(), 41: set(), 44: set(),
}


@pytest.fixture(scope="module")
def judged(spark):
    return vd.with_verdict(vd.with_rules(messages(spark, SF))).cache()


def judge(spark, *texts, p=0.1):
    rows = spark.createDataFrame([(i, x, p) for i, x in enumerate(texts)], "msg_id long, text string, p double")
    return vd.with_verdict(vd.with_rules(rows)).orderBy("msg_id").collect()


def test_link_kinds(spark):
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(KINDS)], "id long, link string, expected string")
    missed = ln.case_report(cases, ["id"]).where("NOT passed").collect()
    assert missed == []


def test_rules_fire_where_meant(judged):
    got = {row.msg_id: {f.id for f in row.flags} for row in judged.where(F.col("msg_id") < len(TEMPLATES)).collect()}
    assert {k: got[k] for k in FIRES} == FIRES
    assert {x.id for x in r.RULES} <= set().union(*got.values())


def test_properties(judged):
    assert judged.where("verdict IS NULL").count() == 0
    assert judged.select("msg_id").distinct().count() == judged.count()
    high = F.exists("flags", lambda f: f["severity"] == "high")
    assert judged.where(high & (F.col("verdict") != "spam")).count() == 0
    assert judged.where(F.col("safe.applies") & (F.size("flags") > 0)).count() == 0


def test_negated_credentials_and_windows(spark):
    rows = judge(
        spark,
        "Rs 5 debited from a/c XX123. Never ever share your OTP.",
        "Rs 5 debited from a/c XX123. Do not worry today. Just share your OTP.",
        "Rs 5 debited from a/c XX123. Never tell your PIN. Then update your password",
    )
    kinds = [[b.kind for b in row.safe.blocked_by] for row in rows]
    assert "credentials" not in kinds[0] and "credentials" in kinds[1] and "credentials" in kinds[2]


def test_own_block_does_not_stop_a_clean_signal(spark):
    row = judge(spark, "KYC has been verified, expense approved. Click to view")[0]
    assert {s.id: s.own_block is None for s in row.safe.signals} == {"kyc_complete": False, "expense_approval": True}
    assert row.safe.applies


def test_snippets_cut_and_distinct(spark):
    row = judge(spark, "lottery " + "x" * 80, "PAY pay: parcel pay fee call Call")
    assert all(len(m) <= 60 for f in row[0].flags for m in f.matched)
    for f in row[1].flags:
        low = [m.lower() for m in f.matched]
        assert len(low) == len(set(low))


def test_percent_halves_to_even(spark):
    rows = spark.createDataFrame([(0.125,), (0.375,), (0.5,)], "p double")
    assert [x[0] for x in rows.select(vd.percent(F.col("p"))).collect()] == ["12%", "38%", "50%"]


def test_rule_job_has_no_shuffle_and_finds_links_once(spark):
    # another folder than the cached fixture, so that the plan is the job's own
    job = vd.with_verdict(vd.with_rules(messages(spark, SF.replace("0.001", "0.01")))).select("msg_id", "verdict")
    plan = job._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    optimized = job._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(text#\d+, " + re.escape(h.LINK[:20]), optimized)) == 1


def test_every_link_of_a_text_is_parsed(spark):
    from siftwire.operators import links as ln

    texts = ["see sbi.co.in and hdfc-kyc.xyz", "https://localhost/x or bit.ly/abc", "no link", "a.example.com a.example.com bit.ly/x amzn.to/y"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")
    rows = ln.parse_hosts(df, "text").orderBy("msg_id", "pos").collect()
    assert [(r.msg_id, r.pos, r.host) for r in rows] == [
        (0, 0, "sbi.co.in"), (0, 1, "hdfc-kyc.xyz"), (1, 0, "localhost"), (1, 1, "bit.ly"),
        (3, 0, "a.example.com"), (3, 1, "a.example.com"), (3, 2, "bit.ly"), (3, 3, "amzn.to")]


def test_planning_starts_no_job_and_a_work_folder_is_required(spark):
    from siftwire.catalog.base import docs
    from siftwire.functions import text as t
    from siftwire.operators.normal import with_normalised
    from siftwire.sources.sinks import shared_dir

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = spark.range(100).selectExpr("id AS msg_id", "CAST(id AS string) AS text").groupBy("msg_id", "text").count()
    with_normalised(df).select("norm")
    assert len(tracker.getJobIdsForGroup(None)) == before and docs is not None

    class Unset:
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Unset(), "x")
    long = spark.createDataFrame([(1, "a" * 7000)], "msg_id long, text string")
    row = with_normalised(long, limits=t.SHORT_TEXTS).first()
    assert len(row.norm) == 6000 and len(row.norm_short) == 1500 and len(with_normalised(long).first().norm_short) == 7000
    assert len(long.select(t.clean("text", t.SHORT_TEXTS["clean"]).alias("c")).first().c) == 4000
