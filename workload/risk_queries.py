"""Scoring, ranking, segments and recommendations."""

from pyspark.sql import functions as F

from ebbtide.functions import columns as X
from ebbtide.operators import breakdown, rank, recommend, risk
from ebbtide.plans import scoring
from workload.registry import query
from workload.sql_parts import CHAIN_RECS, INTEL, LEVEL_P, LEVEL_S, RECS, SCORED
from workload.views import customer_360, dirty_customer, r2, stored, table, unlabelled, with_views


def intel(spark, sf):
    return risk.customer_intelligence(stored(customer_360, spark, sf))


def recs(spark, sf):
    return recommend.recommendations(intel(spark, sf))


def scored(spark, sf):
    return scoring.predict_customers(stored(unlabelled, spark, sf), clean=False)


# --- scalar functions ---------------------------------------------------------------------------

@query("f1_number", with_views("""
SELECT customer_id, TRY_CAST(trim(monthly_charges) AS DOUBLE) AS plain_number,
       TRY_CAST(trim(regexp_replace(monthly_charges, '[,$₹€£]', '', 'g')) AS DOUBLE) AS money_number,
       coalesce(TRY_CAST(trim(tenure) AS DOUBLE), 0) AS tenure_or_zero FROM dirty_customer""", dirty=True))
def f1_number(spark, sf):
    d = dirty_customer(spark, sf)
    return d.select("customer_id", X.number(d, "monthly_charges").alias("plain_number"),
                    X.number(d, "monthly_charges", currency=True).alias("money_number"),
                    X.number_or_zero(d, "tenure").alias("tenure_or_zero"))


@query("f2_text_normalize", with_views("""
SELECT customer_id, lower(trim(contract)) AS contract_text, lower(trim(churn)) AS churn_text
FROM dirty_customer""", dirty=True))
def f2_text_normalize(spark, sf):
    d = dirty_customer(spark, sf)
    return d.select("customer_id", X.lower_text("contract").alias("contract_text"),
                    X.lower_text("churn").alias("churn_text"))


@query("f3_probability", with_views("""
SELECT customer_id, churn_probability * CAST(100 AS DOUBLE) AS probability,
       CASE WHEN total_charges < 0 THEN 0 WHEN total_charges > 100 THEN 100 ELSE total_charges END AS clipped
FROM customer_360"""))
def f3_probability(spark, sf):
    d = customer_360(spark, sf)
    return d.select("customer_id", breakdown.probability(d, breakdown.probability_factor(d)).alias("probability"),
                    X.clip(F.col("total_charges"), 0, 100).alias("clipped"))


@query("f4_churn_status", with_views("""
SELECT customer_id,
  CASE WHEN lower(trim(churn)) IN ('yes','true','1','churn','churned') THEN 'Churn'
       WHEN lower(trim(churn)) IN ('no','false','0','retain','retained','active') THEN 'Retained' ELSE 'Unknown' END AS status,
  coalesce(lower(trim(churn)) IN ('yes','true','1','churn','churned','high risk','high-risk','critical'), false) AS churn_mask
FROM dirty_customer""", dirty=True))
def f4_churn_status(spark, sf):
    return dirty_customer(spark, sf).select("customer_id", X.status("churn").alias("status"),
                                            X.churn_mask("churn").alias("churn_mask"))


@query("f5_risk_level_of_probability", with_views(f"""
SELECT customer_id, {LEVEL_P.format(p='churn_probability')} AS risk_level FROM customer_360"""))
def f5_risk_level_of_probability(spark, sf):
    return customer_360(spark, sf).select(
        "customer_id", X.risk_level_of_probability(F.col("churn_probability")).alias("risk_level"))


@query("f6_risk_score_of_probability", with_views(f"""
SELECT customer_id, {r2('churn_probability * CAST(100 AS DOUBLE)')} AS risk_score FROM customer_360"""))
def f6_risk_score_of_probability(spark, sf):
    return customer_360(spark, sf).select(
        "customer_id", X.risk_score_of_probability(F.col("churn_probability")).alias("risk_score"))


@query("f7_risk_level_of_score", with_views(f"""
SELECT customer_id, {LEVEL_S.format(s='(churn_probability * 100)')} AS risk_level FROM customer_360"""))
def f7_risk_level_of_score(spark, sf):
    return customer_360(spark, sf).select(
        "customer_id", X.risk_level_of_score(F.col("churn_probability") * 100).alias("risk_level"))


@query("f8_text_tests", with_views("""
SELECT customer_id,
  CASE WHEN regexp_matches(lower(contract), 'two year') THEN 15 WHEN regexp_matches(lower(contract), 'one year') THEN 45
       WHEN contains(lower(contract), 'month') THEN 100 ELSE 50 END::DOUBLE AS contract_points,
  CASE WHEN contains(lower(payment_method), 'electronic check') THEN 100 ELSE 40 END::DOUBLE AS payment_points
FROM customer_360"""))
def f8_text_tests(spark, sf):
    return customer_360(spark, sf).select(
        "customer_id", risk.contract_points("contract").alias("contract_points"),
        risk.payment_points("payment_method").alias("payment_points"))


@query("f9_money_text", with_views("""
SELECT customer_id, format('{:,.2f}', total_charges) AS money FROM customer_360"""))
def f9_money_text(spark, sf):
    return customer_360(spark, sf).select("customer_id", X.money_text(F.col("total_charges")).alias("money"))


@query("f10_logistic", with_views(f"""
SELECT customer_id, {r2('''CASE WHEN recency_months IS NOT NULL THEN 1 / (1 + exp(-least(greatest((recency_months - 6) / CAST(3 AS DOUBLE), CAST(-50 AS DOUBLE)), CAST(50 AS DOUBLE)))) END''', 8)} AS p
FROM customer_360"""))
def f10_logistic(spark, sf):
    return customer_360(spark, sf).select("customer_id", F.round(X.logistic((F.col("recency_months") - 6) / 3.0), 8).alias("p"))


@query("f11_prediction_label", with_views("""
SELECT customer_id, CASE WHEN churn_probability >= 0.5 THEN 'Churn' ELSE 'Retained' END AS from_number,
       CASE WHEN lower(trim(churn)) IN ('1','yes','true','churn','churned','left','cancelled','canceled','inactive','attrited')
            THEN 'Churn' ELSE 'Retained' END AS from_word FROM customer_360"""))
def f11_prediction_label(spark, sf):
    d = customer_360(spark, sf)
    return d.select("customer_id", X.prediction_label(d, "churn_probability").alias("from_number"),
                    X.prediction_label(d, "churn").alias("from_word"))


@query("f12_generated_ids", with_views("""
SELECT customer_key, format('CUST-{:05d}', row_number() OVER (ORDER BY customer_key)) AS generated_customer_id
FROM customer_360"""))
def f12_generated_ids(spark, sf):
    d = stored(customer_360, spark, sf).select("customer_key", "tenure")
    return scoring.with_customer_ids(
        d.withColumnRenamed("customer_key", "ordinal"), order="ordinal").select(
        F.col("ordinal").alias("customer_key"), "generated_customer_id")


# --- scores -----------------------------------------------------------------------------------------

@query("i1_customer_risk_score", with_views(
    "SELECT customer_id, customer_risk_score FROM intel", extra=INTEL))
def i1_customer_risk_score(spark, sf):
    d = stored(customer_360, spark, sf)
    profile = risk.fit_intelligence(d)
    p = F.round(F.coalesce(breakdown.probability(d, profile.factor), F.lit(0.0)), 2)
    return d.select("customer_id", risk.customer_risk_score(d, profile, p).alias("customer_risk_score"))


@query("i2_customer_value", with_views(f"""
SELECT customer_id, {r2('coalesce(total_charges, 0)')} AS by_total,
       {r2('coalesce(monthly_charges, 0) * coalesce(CAST(tenure AS DOUBLE), 0)')} AS by_tenure,
       {r2('coalesce(monthly_charges, 0)')} AS by_month FROM customer_360"""))
def i2_customer_value(spark, sf):
    d = customer_360(spark, sf)
    return d.select("customer_id", risk.customer_value(d).alias("by_total"),
                    risk.customer_value(d.drop("total_charges")).alias("by_tenure"),
                    risk.customer_value(d.drop("total_charges", "tenure")).alias("by_month"))


@query("i3_behavioral_risk", with_views(
    f"SELECT customer_id, {r2('risk', 8)} AS risk FROM risky", extra=SCORED))
def i3_behavioral_risk(spark, sf):
    return risk.behavioral_scores(stored(unlabelled, spark, sf)).select("customer_id", F.round("risk", 8).alias("risk"))


def _scale(c, name, reverse=False):
    s = f"least(greatest(({{v}} - {name}.lo) / ({name}.hi - {name}.lo), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"
    return (f"CASE WHEN {name}.hi <= {name}.lo THEN CAST(0.5 AS DOUBLE) ELSE {'1 - ' if reverse else ''}"
            + s.format(v=f"coalesce(CAST({c} AS DOUBLE), {name}.md)") + " END")


def _cuts(c, name, source="customer_360"):
    return (f"{name} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.05) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.95) AS hi FROM {source})")


@query("i4_numeric_score", with_views(f"""
SELECT customer_id, {r2(_scale('tenure', 'ct', True), 6)} AS tenure_score,
       {r2(_scale('monthly_charges', 'cm'), 6)} AS charge_score,
       {r2(_scale('usage_events', 'cu', True), 6)} AS usage_score
FROM customer_360 CROSS JOIN ct CROSS JOIN cm CROSS JOIN cu""",
    extra=",\n".join([_cuts("tenure", "ct"), _cuts("monthly_charges", "cm"), _cuts("usage_events", "cu")])))
def i4_numeric_score(spark, sf):
    d = stored(customer_360, spark, sf)
    names = ["tenure", "monthly_charges", "usage_events"]
    rows = d.select(*[X.number(d, c).alias(c) for c in names])
    cuts = rank.exact_quantiles(rows, names, [0.05, 0.5, 0.95])
    counts = rank.agg_values(rows, {c: F.count(c) for c in names})
    scales = {c: [*cuts[c], counts[c]] for c in names}
    return d.select("customer_id", *[
        F.round(risk.numeric_score(X.number(d, c), scales[c], rev), 6).alias(out)
        for c, rev, out in (("tenure", True, "tenure_score"), ("monthly_charges", False, "charge_score"),
                            ("usage_events", True, "usage_score"))])


UNIVERSAL = ",\n".join([
    _cuts("tenure", "ct"), _cuts("monthly_charges", "cm"), _cuts("usage_events", "cu"),
    _cuts("support_tickets", "cs"), f"""
universal AS (
  SELECT c.*, (({_scale('tenure', 'ct', True)}) * CAST(1.5 AS DOUBLE) + ({_scale('usage_events', 'cu', True)}) * CAST(1.5 AS DOUBLE)
    + ({_scale('support_tickets', 'cs')}) * CAST(1.5 AS DOUBLE) + ({_scale('monthly_charges', 'cm')}) * CAST(0.75 AS DOUBLE)
    + CASE WHEN regexp_matches(lower(trim(contract)), '\\b(inactive|cancel|complaint|poor|low|bad|month-to-month|monthly|declined|negative|unhappy|dissatisfied|expired|overdue|late)') THEN 0.75
           WHEN regexp_matches(lower(trim(contract)), '\\b(active|annual|yearly|premium|loyal|good|excellent|satisfied|engaged)') THEN 0.25 ELSE 0.5 END::DOUBLE * CAST(1.5 AS DOUBLE)
    + CAST(0.5 AS DOUBLE) * CAST(0.5 AS DOUBLE)) / CAST(7.25 AS DOUBLE) AS risk
  FROM customer_360 c CROSS JOIN ct CROSS JOIN cm CROSS JOIN cu CROSS JOIN cs)"""])


@query("i5_universal_risk", with_views(
    f"""SELECT customer_id, {r2('risk', 6)} AS risk, CASE WHEN risk >= 0.5 THEN 'Churn' ELSE 'Retained' END AS churn_prediction
        FROM universal""", extra=UNIVERSAL))
def i5_universal_risk(spark, sf):
    d = stored(customer_360, spark, sf)
    x = risk.universal_risk(d, risk.fit_universal(d))
    return d.select("customer_id", F.round(x, 6).alias("risk"),
                    F.when(x >= 0.5, "Churn").otherwise("Retained").alias("churn_prediction"))


@query("i6_keyword_risk", with_views("""
SELECT 'contract' AS signal, customer_key AS key,
       CASE WHEN regexp_matches(lower(contract), '\\bmonth-to-month') THEN 0.75 ELSE 0.5 END::DOUBLE AS risk FROM customer_360
UNION ALL SELECT 'priority', o_orderkey,
       CASE WHEN regexp_matches(lower(o_orderpriority), '\\blow') THEN 0.75 ELSE 0.5 END::DOUBLE FROM orders"""))
def i6_keyword_risk(spark, sf):
    parts = [d.select(F.lit(signal).alias("signal"), F.col(key).alias("key"), risk.keyword_risk(c).alias("risk"))
             for signal, d, key, c in (
                 ("contract", customer_360(spark, sf), "customer_key", "contract"),
                 ("priority", table(spark, sf, "orders"), "o_orderkey", "o_orderpriority"))]
    return parts[0].unionByName(parts[1])


@query("i7_strategic_segment", with_views(
    "SELECT customer_id, strategic_segment FROM intel", extra=INTEL))
def i7_strategic_segment(spark, sf):
    return intel(spark, sf).select("customer_id", "strategic_segment")


INTEL_COLUMNS = ["customer_id", "churn_probability", "customer_risk_score", "risk_level", "customer_value",
                 "strategic_segment", "retention_priority", "priority_rank", "revenue_at_risk"]


@query("i8_customer_intelligence", with_views(
    f"SELECT {', '.join(INTEL_COLUMNS)} FROM intel", extra=INTEL))
def i8_customer_intelligence(spark, sf):
    return intel(spark, sf).select(*INTEL_COLUMNS)


@query("i9_derived_features", with_views("""
SELECT customer_id, CASE WHEN usage_events IS NULL THEN 1 ELSE 0 END AS usage_events_missing,
       CASE WHEN support_tickets IS NULL THEN 1 ELSE 0 END AS support_tickets_missing,
       CAST(tenure AS DOUBLE) AS signal_tenure, CAST(recency_months AS DOUBLE) AS signal_recency,
       CAST(usage_events AS DOUBLE) AS signal_usage, CAST(support_tickets AS DOUBLE) AS signal_support,
       monthly_charges AS signal_spend FROM customer_360"""))
def i9_derived_features(spark, sf):
    return risk.derived_features(stored(unlabelled, spark, sf)).select(
        "customer_id", "usage_events_missing", "support_tickets_missing", "signal_tenure",
        "signal_recency", "signal_usage", "signal_support", "signal_spend")


SCORED_COLUMNS = ["customer_id", "churn_prediction", "churn_probability", "risk_score", "risk_level",
                  "prediction_method"]


@query("i10_score_customers", with_views(f"SELECT {', '.join(SCORED_COLUMNS)} FROM scored", extra=SCORED))
def i10_score_customers(spark, sf):
    return scored(spark, sf).select(*SCORED_COLUMNS)


@query("i10_score_customers_universal", with_views(f"""
SELECT customer_id, CASE WHEN risk >= 0.5 THEN 'Churn' ELSE 'Retained' END AS churn_prediction,
       {r2('risk * CAST(100 AS DOUBLE)')} AS churn_probability, {LEVEL_P.format(p='risk')} AS risk_level
FROM universal""", extra=UNIVERSAL))
def i10_score_customers_universal(spark, sf):
    d = stored(customer_360, spark, sf)
    return scoring.predict_customers(d, universal=True, clean=False).select(
        "customer_id", "churn_prediction", "churn_probability", "risk_level")


# --- ranks ----------------------------------------------------------------------------------------

@query("w1_priority_rank", with_views(
    "SELECT customer_id, customer_risk_score, priority_rank FROM intel", extra=INTEL))
def w1_priority_rank(spark, sf):
    return intel(spark, sf).select("customer_id", "customer_risk_score", "priority_rank")


def _pct(c, source="customer_360"):
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {c}) + 1) / CAST(2 AS DOUBLE)) "
            f"/ (SELECT count({c}) FROM {source}) END")


@query("w2_value_percentile", with_views(
    f"SELECT customer_id, {r2(_pct('total_charges') + ' * 100', 6)} AS value_percentile FROM customer_360 WHERE total_charges IS NOT NULL"))
def w2_value_percentile(spark, sf):
    d = stored(customer_360, spark, sf)
    return rank.percentile_ranks(d, ["total_charges"], "customer_id").select(
        "customer_id", F.round(F.col("percentile") * 100, 6).alias("value_percentile"))


W3_COLUMNS = ["senior_citizen", "tenure", "usage_events", "total_charges", "monthly_charges"]


@query("w3_mean_percentile", with_views(f"""
SELECT customer_id, {r2('list_avg([' + ', '.join('p_' + c for c in W3_COLUMNS) + '])', 6)} AS mean_percentile
FROM (SELECT customer_id, {', '.join(_pct(c) + ' AS p_' + c for c in W3_COLUMNS)} FROM customer_360)"""))
def w3_mean_percentile(spark, sf):
    d = stored(customer_360, spark, sf)
    return risk.mean_percentiles(d, W3_COLUMNS, "customer_id").select(
        "customer_id", F.round("mean_percentile", 6).alias("mean_percentile"))


@query("w4_value_tiers", with_views("""
SELECT customer_id, monthly_charges AS monthly_value, total_charges AS total_value,
       CASE churn WHEN 'Yes' THEN 'Churn' WHEN 'No' THEN 'Retained' ELSE 'Unknown' END AS churn_status,
       CASE WHEN monthly_charges >= (SELECT quantile_cont(monthly_charges, 0.75) FROM customer_360) THEN 'High Value'
            ELSE 'Standard Value' END AS customer_value_tier FROM customer_360"""))
def w4_value_tiers(spark, sf):
    return breakdown.customer_value_tiers(stored(customer_360, spark, sf)).select(
        "customer_id", "monthly_value", "total_value", "churn_status", "customer_value_tier")


# --- recommendations -----------------------------------------------------------------------------

REC_COLUMNS = ["customer_id", "retention_priority", "recommended_action", "retention_recommendation"]


@query("r1_customer_action", with_views(f"SELECT {', '.join(REC_COLUMNS)} FROM recs", extra=RECS))
def r1_customer_action(spark, sf):
    d = intel(spark, sf)
    a = recommend.action(d)
    return d.select("customer_id", a["priority"].alias("retention_priority"),
                    a["action"].alias("recommended_action"), a["recommendation"].alias("retention_recommendation"))


@query("r2_recommendations", with_views(
    f"SELECT {', '.join(REC_COLUMNS)}, retention_urgency_score, recommended_channel, revenue_at_risk FROM recs", extra=RECS))
def r2_recommendations(spark, sf):
    return recs(spark, sf).select(*REC_COLUMNS, "retention_urgency_score", "recommended_channel", "revenue_at_risk")


CHAIN_COLUMNS = ["customer_id", "churn_prediction", "churn_probability", "customer_risk_score", "risk_level",
                 "strategic_segment", "priority_rank", "revenue_at_risk", "retention_priority",
                 "recommended_action", "retention_urgency_score", "recommended_channel"]


@query("r4_retention_plan", with_views(
    f"SELECT {', '.join(CHAIN_COLUMNS)} FROM chain_recs", extra=CHAIN_RECS))
def r4_retention_plan(spark, sf):
    return scoring.retention_plan(stored(unlabelled, spark, sf), clean=False).select(*CHAIN_COLUMNS)
