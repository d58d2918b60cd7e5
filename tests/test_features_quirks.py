"""Hand-made rows for the committee/sponsor chain and its literal quirks (answers derived by hand)."""

import datetime as dt

from pyspark.sql import functions as F

from billcov.functions.numeric import percent_text
from billcov.functions.text import remove_first, remove_words
from billcov.operators import features
from billcov.operators.model_table import model_frame, top_topic

H = "bill_id long, sequence int, action string"


def _cf(spark, rows, **kw):
    df = spark.createDataFrame(rows, H)
    return {r.bill_id: r for r in features.committee_features(df, **kw).collect()}


def test_chain_leading_space_order_and_count(spark):
    rows = [
        (1, 1, "Introduced"),
        (1, 2, "Assigned to Senate FINANCE Committee"),
        (1, 3, "Assigned to Senate RULES Committee"),      # dropped: RULES and 3 assignments
        (1, 4, "Assigned to House JUDICIARY Committee"),
        (1, 5, "Assigned to Senate FINANCE Committee"),    # repeated name: counted, listed once
    ]
    r = _cf(spark, rows)[1]
    assert r.Committees_Concat == " FINANCE, JUDICIARY"
    assert r.Committee_Intro_Count == 3
    assert r.sen_intro == 1


def test_rules_only_once_survives_twice_vanishes(spark):
    rows = [
        (2, 1, "Assigned to House RULES Committee"),
        (3, 1, "Assigned to House RULES Committee"),
        (3, 2, "Assigned to House RULES Committee"),
    ]
    got = _cf(spark, rows)
    assert got[2].Committees_Concat == " RULES" and got[2].Committee_Intro_Count == 1
    assert 3 not in got  # Q23: count 2 → every RULES row dropped


def test_no_chamber_rows_count_for_rules_rule_but_are_dropped(spark):
    rows = [
        (4, 1, "Assigned to JOINT Committee"),
        (4, 2, "Assigned to Senate RULES Committee"),
    ]
    assert 4 not in _cf(spark, rows)  # count is 2 (JOINT counts), RULES dropped, JOINT has no chamber


def test_within_first_option(spark):
    rows = [(5, 1, "Assigned to House FINANCE Committee"), (5, 9, "Assigned to House EDUCATION Committee")]
    assert _cf(spark, rows)[5].Committee_Intro_Count == 2            # literal: no-op filter (Q6)
    assert _cf(spark, rows, within_first=5)[5].Committee_Intro_Count == 1


def test_first_chamber_only_option(spark):
    rows = [(7, 1, "Assigned to Senate FINANCE Committee"), (7, 2, "Assigned to House EDUCATION Committee"),
            (7, 3, "Assigned to JOINT Committee")]
    assert _cf(spark, rows)[7].Committee_Intro_Count == 2                      # literal: both chambers (Q7)
    r = _cf(spark, rows, first_chamber_only=True)[7]
    assert r.Committee_Intro_Count == 1 and r.Committees_Concat == " FINANCE"


def test_first_row_order_uses_total_order(spark):
    rows = [(6, 2, "Assigned to House FINANCE Committee"), (6, 1, "Assigned to Senate EDUCATION Committee")]
    r = _cf(spark, rows)[6]
    assert r.Committees_Concat == " EDUCATION, FINANCE" and r.sen_intro == 1


def test_sponsor_share_null_party_and_half_even(spark):
    sponsors = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)] + [(3, 10 + i) for i in range(8)],
                                     "bill_id long, people_id long")
    people = spark.createDataFrame(
        [(10, "R"), (11, "D"), (12, None), (13, "D"), (14, "D"), (15, "D"), (16, "D"), (17, "D")],
        "people_id long, party string")
    got = {r.bill_id: r for r in features.sponsor_features(sponsors, people).collect()}
    assert got[1].SponsorCount == 2 and got[1].RepubSponsorPct == 0.5
    assert got[2].RepubSponsorPct is None  # NA party → NA share (R sum without na.rm)
    assert got[3].RepubSponsorPct is None  # people 12 has null party
    half = spark.createDataFrame([(0.0625,), (0.125,)], "x double").select(F.bround("x", 3).alias("b"), F.bround("x", 2).alias("c"))
    assert [tuple(r) for r in half.collect()] == [(0.062, 0.06), (0.125, 0.12)]


def test_passed_null_stays_null(spark):
    bills = spark.createDataFrame([(1, "HB1", "2015", "Chapter 5"), (2, "SB2", "2015", None), (3, "HB3", "2015", "Vetoed")],
                                  "bill_id long, bill_number string, year string, last_action string")
    got = {r.bill_id: r.passed for r in features.bill_passed(bills).collect()}
    assert got == {1: 1, 2: None, 3: 0}


def test_bill_features_fills_and_sponsors_hang_off_committees(spark):
    bills = spark.createDataFrame([(1, "SB1", "2015", None), (2, "HB2", "2015", "Chapter 1")],
                                  "bill_id long, bill_number string, year string, last_action string")
    hist = spark.createDataFrame([(1, 1, "Assigned to Senate FINANCE Committee")], H)
    sponsors = spark.createDataFrame([(1, 10), (2, 10)], "bill_id long, people_id long")
    people = spark.createDataFrame([(10, "R")], "people_id long, party string")
    got = {r.bill_id: r for r in features.bill_features(bills, hist, sponsors, people).collect()}
    assert got[1].SponsorCount == 1 and got[1].sen_intro == 1
    assert got[2].Committees_Concat == "RULES" and got[2].Committee_Intro_Count == 0
    assert got[2].SponsorCount is None and got[2].sen_intro == 0  # Q8: no committee row → no sponsor features


def test_model_frame_recounts_and_zero_fills(spark):
    df = spark.createDataFrame([("HB1", "2015", None, 5, " A, B", 0, None, None, 0, 0, 0, 0, None, "Topic1")],
                               "bill_number string, year string, passed int, Committee_Intro_Count long, Committees_Concat string, "
                               "sen_intro int, SponsorCount long, RepubSponsorPct double, AZCen_Count long, AZDS_Count long, "
                               "AZCap_Count long, PNT_Count long, Bill_Sim_Binary int, Top_Topic string")
    r = model_frame(df).first()
    assert r.Committee_Intro_Count == 2 and r.passed == 0 and r.SponsorCount == 0 and r.RepubSponsorPct == 0.0


def test_top_topic_first_wins_and_generic_k(spark):
    df = spark.createDataFrame([("a", "1", 0.2, 0.5, 0.5, 0.1), ("b", "1", 0.3, 0.3, 0.1, 0.3)],
                               "bill_number string, year string, Topic1 double, Topic2 double, Topic3 double, Topic4 double")
    got = {r.bill_number: r.Top_Topic for r in top_topic(df).collect()}
    assert got == {"a": "Topic2", "b": "Topic1"}


def test_string_helpers(spark):
    df = spark.createDataFrame([("Assigned to Senate Senate RULES Committee",)], "a string")
    r = df.select(remove_words("a", ["Assigned to ", " Committee"]).alias("w"),
                  remove_first("a", "Senate").alias("f")).first()
    assert r.w == "Senate Senate RULES"
    assert r.f == "Assigned to  Senate RULES Committee"
    p = spark.createDataFrame([(12.0,), (12.5,), (-0.634,), (3.14159,)], "x double").select(percent_text("x").alias("p"))
    assert [x.p for x in p.collect()] == ["12%", "12.5%", "-0.63%", "3.14%"]


def test_dates_add_months_clamps_month_end(spark):
    df = spark.createDataFrame([(dt.date(2020, 8, 31),)], "d date").select(F.add_months("d", -6).alias("x"))
    assert df.first().x == dt.date(2020, 2, 29)


def test_actions_are_dealt_once_and_bills_with_many_collapse_first(spark, monkeypatch):
    """Both ways give the same rows; without such bills only one exchange of actions is planned."""
    from billcov.operators import features

    rows = [(b, s, f"Assigned to {c} {n} Committee") for b in range(9) for s, c, n in
            [(k, ("Senate", "House")[(b + k) % 2], ("RULES", "FINANCE", "JUDICIARY", "EDUCATION")[(b * k) % 4]) for k in range(1 + 3 * b)]]
    history = spark.createDataFrame(rows + [(None, 1, "Assigned to House FINANCE Committee")], "bill_id long, sequence int, action string")
    once = features.committee_features(history)
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for most in (0, 10):
        monkeypatch.setattr(features, "MANY_ACTIONS", most)
        assert sorted(map(str, features.committee_features(history).collect())) == sorted(map(str, once.collect()))
