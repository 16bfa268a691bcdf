"""Worked examples with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import recommend, risk


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([
        ("C001", 0.91, 2, 90, 180, "Month-to-month"), ("C002", 0.72, 8, 85, 680, "Month-to-month"),
        ("C003", 0.24, 48, 60, 2880, "One year"), ("C004", 0.08, 60, 45, 2700, "Two year")],
        ["customerID", "Churn Probability", "tenure", "MonthlyCharges", "TotalCharges", "Contract"])


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame([
        ("C001", 91, 90, "Critical", "Critical Retention", 90, 180),
        ("C002", 72, 70, "High", "High Value At Risk", 85, 680),
        ("C003", 24, 25, "Low", "Loyal Customer", 60, 2880),
        ("C004", 8, 10, "Low", "Stable Valuable", 45, 2700)],
        ["customerID", "Churn Probability", "Customer Risk Score", "Risk Level", "Strategic Segment",
         "MonthlyCharges", "Customer Value"])


def test_customer_intelligence(segments):
    got = risk.customer_intelligence(segments).orderBy("customerID").select(
        "churn_probability", "customer_risk_score", "risk_level", "customer_value", "strategic_segment",
        "retention_priority", "priority_rank", "revenue_at_risk").collect()
    assert [tuple(r) for r in got] == [
        (91.0, 88.42, "Critical", 180.0, "Critical Retention", "Immediate", 1, 163.8),
        (72.0, 73.4, "High", 680.0, "Standard Customer", "High", 2, 489.6),
        (24.0, 25.95, "Low", 2880.0, "Loyal Customer", "Low", 3, 691.2),
        (8.0, 8.32, "Low", 2700.0, "Loyal Customer", "Low", 4, 216.0)]


def test_recommendations(actions):
    got = recommend.recommendations(actions).orderBy("customerID").select(
        "retention_priority", "recommended_channel", "revenue_at_risk", "retention_urgency_score",
        "recommended_action").collect()
    assert [tuple(r)[:4] for r in got] == [
        ("Immediate", "Personal Outreach", 163.8, 70.11), ("High", "Targeted Campaign", 489.6, 70.25),
        ("Low", "Standard Engagement", 691.2, 47.5), ("Low", "Standard Engagement", 216.0, 16.38)]
    starts = ["Contact customer immediately", "Launch an early-tenure", "Maintain service quality",
              "Maintain service quality"]
    assert all(r[4].startswith(s) for r, s in zip(got, starts))


def test_business_summary(actions):
    got = recommend.business_summary(recommend.recommendations(actions)).first()
    assert tuple(got) == (4, 1, 1, 0, 2, 161.1, 1560.6, 48.75, 48.75)


def test_executive_recommendations(actions):
    got = [r["insight"] for r in recommend.executive_recommendations(
        recommend.recommendations(actions)).orderBy("seq").collect()]
    assert len(got) == 4
    assert got[0].startswith("Prioritize immediate outreach to 1 critical")
    assert got[2] == "Focus retention resources on the estimated 161.10 monthly revenue at risk."
    assert got[3].startswith("Maintain active churn monitoring")


def test_probability_spellings(spark):
    for texts in (["82%", "10%"], ["82", "10"], ["0.82", "0.1"]):
        df = spark.createDataFrame([(t,) for t in texts], ["Churn Probability"])
        got = risk.customer_intelligence(df).agg(F.sort_array(F.collect_list("churn_probability"))).first()[0]
        assert got == [10.0, 82.0], texts


def test_profile_scores_a_later_batch_unchanged(spark, segments):
    profile = risk.IntelligenceProfile.from_json(risk.fit_intelligence(segments).to_json())
    whole = {r["customerID"]: r["customer_risk_score"]
             for r in risk.customer_intelligence(segments, profile).collect()}
    part = risk.customer_intelligence(segments.where("customerID = 'C004'"), profile).first()
    assert part["customer_risk_score"] == whole["C004"]


def test_correlations_over_several_tiles(spark):
    """More columns than one tile holds, against the plain formula."""
    import itertools
    import statistics

    from ebbtide.operators import stats
    names = [f"c{k}" for k in range(stats.TILE + 3)]
    rows = [tuple(float((r * 7 + k * 3 + r * r * k) % 11) for k in range(len(names))) for r in range(30)]
    got = {(r["feature_a"], r["feature_b"]): r["correlation"]
           for r in stats.correlations(spark.createDataFrame(rows, names)).collect()}
    assert len(got) == len(names) ** 2
    cols = dict(zip(names, zip(*rows)))
    for a, b in itertools.combinations(names, 2):
        assert abs(got[a, b] - statistics.correlation(cols[a], cols[b])) < 1e-9
