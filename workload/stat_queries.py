"""Descriptive statistics and dashboard breakdowns."""

from pyspark.sql import functions as F

from ebbtide.operators import breakdown, explore, recommend, risk, stats
from workload.registry import query
from workload.risk_queries import intel, recs, scored
from workload.sql_parts import INTEL, RECS, SCORED, label, pct
from workload.views import (customer_360, customer_services, dirty_customer, r2, stored, with_views)

Y = label("churn")
LABELLED = f"y AS (SELECT *, {Y} AS yy FROM customer_360)"
LABELLED_DIRTY = f"y AS (SELECT *, {Y} AS yy FROM dirty_customer)"
NUMERIC = ["senior_citizen", "tenure", "recency_months", "usage_events", "support_tickets", "total_charges",
           "monthly_charges", "churn_probability"]
TEXT = ["customer_id", "gender", "plan_segment", "internet_service", "contract", "payment_method", "churn"]


def bands_sql(column, bands):
    """CASE over (edge, label) bands and the VALUES list of (order, label)."""
    case = "CASE " + " ".join(
        f"WHEN {column} <= {edge} THEN '{name}'" if edge is not None else f"WHEN {column} IS NOT NULL THEN '{name}'"
        for edge, name in bands) + " END"
    return case, ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(bands))


@query("e1_churn_analysis", with_views(f"""
SELECT count(yy) AS total_customers, count(*) FILTER (yy = 1) AS churned_customers, count(*) FILTER (yy = 0) AS retained_customers,
  {pct('count(*) FILTER (yy = 1)', 'count(yy)')} AS churn_rate, {pct('count(*) FILTER (yy = 0)', 'count(yy)')} AS retention_rate FROM y""",
    dirty=True, extra=LABELLED_DIRTY))
def e1_churn_analysis(spark, sf):
    return stats.churn_analysis(dirty_customer(spark, sf))


@query("e1_churn_distribution", with_views(f"""
SELECT CASE yy WHEN 1 THEN 'Churned' ELSE 'Retained' END AS status, count(*) AS customers,
  {pct('count(*)', '(SELECT count(yy) FROM y)')} AS percentage FROM y WHERE yy IS NOT NULL GROUP BY yy""", extra=LABELLED))
def e1_churn_distribution(spark, sf):
    return stats.churn_distribution(customer_360(spark, sf))


@query("e2_missing_values", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_values, "
    f"{r2(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100', 8)} AS missing_percentage FROM dirty_customer"
    for c in ("customer_id", "contract", "monthly_charges", "tenure", "churn", "empty_col")), dirty=True))
def e2_missing_values(spark, sf):
    return stats.missing_values(dirty_customer(spark, sf)).withColumn(
        "missing_percentage", F.round("missing_percentage", 8))


def _summary_sql(c):
    d = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS feature, count({c}) AS count, {r2(f'avg({d})', 6)} AS mean, {r2(f'stddev_samp({d})', 6)} AS std, "
            f"min({d}) AS min, {r2(f'quantile_cont({d}, 0.25)', 6)} AS q25, {r2(f'quantile_cont({d}, 0.5)', 6)} AS q50, "
            f"{r2(f'quantile_cont({d}, 0.75)', 6)} AS q75, max({d}) AS max FROM customer_360")


ALL_NUMERIC = [*NUMERIC, *(c for c in ['customer_key', 'senior_citizen', 'tenure', 'recency_months', 'usage_events', 'support_tickets', 'total_charges', 'monthly_charges', 'churn_probability'] if c not in NUMERIC)]


@query("e3_numeric_summary", with_views(" UNION ALL ".join(map(_summary_sql, ALL_NUMERIC))))
def e3_numeric_summary(spark, sf):
    out = stats.numeric_summary(stored(customer_360, spark, sf))
    return out.select("feature", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                      *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("e3_numeric_summary_odd_values", with_views("""
SELECT 'x' AS feature, count(x) AS count, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max
FROM (SELECT CASE WHEN isfinite(v) THEN v END AS x FROM odd)""", extra="""
odd AS (SELECT CASE customer_key % 7 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE)
  WHEN 3 THEN CASE WHEN customer_key % 2 = 0 THEN 1e308 ELSE -1e308 END ELSE monthly_charges END AS v FROM customer_360)"""))
def e3_numeric_summary_odd_values(spark, sf):
    """Infinities and NaN are missing values; the others span more than the range of doubles."""
    k = F.col("customer_key")
    odd = (F.when(k % 7 == 0, float("inf")).when(k % 7 == 1, float("-inf")).when(k % 7 == 2, float("nan"))
           .when(k % 7 == 3, F.when(k % 2 == 0, 1e308).otherwise(-1e308)).otherwise(F.col("monthly_charges")))
    out = stats.numeric_summary(stored(customer_360, spark, sf).select(odd.alias("x")))
    return out.select("feature", "count", "min", "q25", "q50", "q75", "max")


@query("e4_categorical_summary", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM customer_360) AS unique_values, {c} AS most_common, n AS most_common_count "
    f"FROM (SELECT {c}, count(*) AS n FROM customer_360 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
    for c in TEXT)))
def e4_categorical_summary(spark, sf):
    return stats.categorical_summary(customer_360(spark, sf))


def _by_column(c, source="y", having=""):
    return f"""SELECT coalesce({c}, 'Unknown') AS category, count(*) AS customers, CAST(sum(yy) AS BIGINT) AS churned,
      {r2('sum(yy) / CAST(count(*) AS DOUBLE) * 100')} AS churn_rate, {r2('100 - sum(yy) / CAST(count(*) AS DOUBLE) * 100')} AS retention_rate
      FROM {source} WHERE yy IS NOT NULL GROUP BY 1 {having}"""


@query("e5_churn_by_column", with_views(_by_column("customer_id", having="HAVING count(*) >= 2"), dirty=True, extra=LABELLED_DIRTY))
def e5_churn_by_column(spark, sf):
    return stats.churn_by_column(dirty_customer(spark, sf), "customer_id", min_group_size=2)


@query("e5_churn_by_segment", with_views(_by_column("plan_segment"), extra=LABELLED))
def e5_churn_by_segment(spark, sf):
    return stats.churn_by_column(customer_360(spark, sf), "plan_segment")


@query("e6_contract_churn", with_views(_by_column("contract"), extra=LABELLED))
def e6_contract_churn(spark, sf):
    return stats.contract_churn(customer_360(spark, sf))


@query("e6_payment_churn", with_views(_by_column("payment_method"), extra=LABELLED))
def e6_payment_churn(spark, sf):
    return stats.payment_churn(customer_360(spark, sf))


def _tenure_bands_sql(bands):
    case, values = bands_sql("tenure", bands)
    return f"""SELECT b.i AS band_order, b.name AS tenure_group, count(y.tenure) AS customers, CAST(coalesce(sum(yy), 0) AS BIGINT) AS churned,
      {pct('coalesce(sum(yy), 0)', 'count(y.tenure)')} AS churn_rate
      FROM (VALUES {values}) b(i, name) LEFT JOIN (SELECT *, {case} AS g FROM y WHERE yy IS NOT NULL AND tenure IS NOT NULL) y ON y.g = b.name
      GROUP BY b.i, b.name"""


@query("e7_tenure_churn", with_views(_tenure_bands_sql(stats.fixed.TENURE_BANDS_LONG), extra=LABELLED))
def e7_tenure_churn(spark, sf):
    return stats.tenure_churn(stored(customer_360, spark, sf))


@query("e7_tenure_churn_short", with_views(
    _tenure_bands_sql(stats.fixed.TENURE_BANDS_MIDDLE),
    extra=f"y AS (SELECT CAST(floor(tenure / 3) AS INTEGER) AS tenure, {Y} AS yy FROM customer_360)"))
def e7_tenure_churn_short(spark, sf):
    d = stored(customer_360, spark, sf)
    return stats.tenure_churn(d.withColumn("tenure", F.floor(F.col("tenure") / 3)))


@query("e8_correlations", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r2(f'corr({a}, {b})', 6)} AS correlation FROM customer_360"
    for a in ALL_NUMERIC for b in ALL_NUMERIC)))
def e8_correlations(spark, sf):
    return stats.correlations(customer_360(spark, sf), ALL_NUMERIC).withColumn(
        "correlation", F.round("correlation", 6))


def _outlier_sql(c):
    q = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM customer_360)"
    n = f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    return f"SELECT '{c}' AS feature, {n} AS outliers, {pct(n, f'count({c})')} AS outlier_percentage FROM customer_360 CROSS JOIN {q}"


@query("e9_outliers", with_views(" UNION ALL ".join(map(_outlier_sql, ALL_NUMERIC))))
def e9_outliers(spark, sf):
    return stats.outliers(stored(customer_360, spark, sf), ALL_NUMERIC)


@query("e10_eda_bundle", with_views(f"""
SELECT 'churn' AS part, count(yy) AS size FROM y UNION ALL SELECT 'distribution', count(DISTINCT yy) FROM y
UNION ALL SELECT 'missing_values', 16 UNION ALL SELECT 'numeric_summary', 9 UNION ALL SELECT 'categorical_summary', 7
UNION ALL SELECT 'contract_analysis', count(DISTINCT contract) FROM y UNION ALL SELECT 'payment_analysis', count(DISTINCT payment_method) FROM y
UNION ALL SELECT 'tenure_analysis', 7 UNION ALL SELECT 'correlation', 9 UNION ALL SELECT 'outliers', 9
UNION ALL SELECT 'insights', 3 UNION ALL SELECT 'profile', count(*) FROM customer_360""", extra=LABELLED))
def e10_eda_bundle(spark, sf):
    parts = stats.run_eda(stored(customer_360, spark, sf))
    parts.pop("detected_columns")
    out = None
    for name, part in parts.items():
        size = {"churn": F.max("total_customers"), "profile": F.max("rows")}.get(name, F.count("*"))
        row = part.agg(size.alias("size")).select(F.lit(name).alias("part"), "size")
        out = row if out is None else out.unionByName(row)
    return out


# --- dashboard breakdowns -----------------------------------------------------------------------

P = "churn_probability * CAST(100 AS DOUBLE)"
CHURNED = "CASE WHEN lower(trim(churn)) IN ('yes','true','1','churn','churned') THEN 1 ELSE 0 END"
DASH = f"f AS (SELECT *, {CHURNED} AS ch, {P} AS pp FROM customer_360)"
DASH_SERVICES = f"f AS (SELECT *, {CHURNED} AS ch, {P} AS pp FROM customer_services)"
RATES = (f"count(*) AS customers, CAST(sum(ch) AS BIGINT) AS churned_customers, {r2('coalesce(avg(pp), 0)')} AS average_probability, "
         f"{pct('sum(ch)', 'count(*)')} AS churn_rate")


def _money(x):
    return r2(f"CAST(coalesce(sum(CAST({x} AS DECIMAL(28,6))), 0) AS DOUBLE)")


@query("e11_contract_breakdown", with_views(
    f"SELECT contract, {RATES}, {_money('CASE WHEN ch = 1 THEN monthly_charges END')} AS revenue_at_risk FROM f GROUP BY contract", extra=DASH))
def e11_contract_breakdown(spark, sf):
    return breakdown.contract_breakdown(customer_360(spark, sf))


def _banded(case, values, name, extra=""):
    return f"""SELECT b.i AS band_order, b.name AS {name}, count(f.ch) AS customers, CAST(coalesce(sum(ch), 0) AS BIGINT) AS churned_customers,
      {r2('coalesce(avg(pp), 0)')} AS average_probability, {pct('coalesce(sum(ch), 0)', 'count(f.ch)')} AS churn_rate {extra}
      FROM (VALUES {values}) b(i, name) LEFT JOIN (SELECT *, {case} AS g FROM f) f ON f.g = b.name GROUP BY b.i, b.name"""


@query("e12_tenure_breakdown", with_views(
    _banded(*bands_sql("tenure", stats.fixed.TENURE_BANDS_DASHBOARD), "tenure_group"), extra=DASH))
def e12_tenure_breakdown(spark, sf):
    return breakdown.tenure_breakdown(customer_360(spark, sf))


@query("e13_charge_breakdown", with_views(_banded(
    "CASE WHEN monthly_charges <= q1 THEN 'Low' WHEN monthly_charges <= q2 THEN 'Medium' WHEN monthly_charges <= q3 THEN 'High' "
    "WHEN monthly_charges IS NOT NULL THEN 'Very High' END",
    "(0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Very High')", "charge_band",
    f", {r2('coalesce(avg(monthly_charges), 0)')} AS average_monthly_charge"), extra=f"""
q AS (SELECT quantile_cont(monthly_charges, 0.25) AS q1, quantile_cont(monthly_charges, 0.5) AS q2, quantile_cont(monthly_charges, 0.75) AS q3 FROM customer_360),
f AS (SELECT c.*, q.*, {CHURNED} AS ch, {P} AS pp FROM customer_360 c CROSS JOIN q)"""))
def e13_charge_breakdown(spark, sf):
    return breakdown.charge_breakdown(stored(customer_360, spark, sf))


@query("e13_charge_breakdown_flat", with_views(f"""
SELECT 0 AS band_order, 'All Customers' AS charge_band, {RATES}, {r2('avg(flat)')} AS average_monthly_charge
FROM (SELECT *, CASE WHEN tenure IS NOT NULL THEN CAST(least(tenure, 3) AS DOUBLE) END AS flat FROM f) WHERE flat IS NOT NULL""", extra=DASH))
def e13_charge_breakdown_flat(spark, sf):
    d = stored(customer_360, spark, sf)
    flat = F.when(F.col("tenure").isNotNull(), F.least("tenure", F.lit(3)).cast("double"))
    return breakdown.charge_breakdown(d.withColumn("monthly_charges", flat))


def _category(c, source="f"):
    return f"SELECT coalesce(trim(CAST({c} AS VARCHAR)), 'Unknown') AS category, {RATES} FROM {source} GROUP BY 1"


@query("e14_category_breakdown", with_views(_category("plan_segment"), extra=DASH))
def e14_category_breakdown(spark, sf):
    return breakdown.category_breakdown(customer_360(spark, sf), ["Plan Segment"])


@query("e15_payment_breakdown", with_views(_category("payment_method"), extra=DASH))
def e15_payment_breakdown(spark, sf):
    return breakdown.payment_breakdown(customer_360(spark, sf))


@query("e15_internet_breakdown", with_views(_category("internet_service"), extra=DASH))
def e15_internet_breakdown(spark, sf):
    return breakdown.internet_breakdown(customer_360(spark, sf))


@query("e15_gender_breakdown", with_views(_category("gender"), extra=DASH))
def e15_gender_breakdown(spark, sf):
    return breakdown.gender_breakdown(customer_360(spark, sf))


@query("e15_senior_breakdown", with_views(_category("CASE senior_citizen WHEN 1 THEN 'Yes' ELSE 'No' END"), extra=DASH))
def e15_senior_breakdown(spark, sf):
    return breakdown.senior_breakdown(customer_360(spark, sf))


def _union(pairs, name):
    return " UNION ALL ".join(f"SELECT '{n}' AS {name}, * FROM ({_category(c)})" for n, c in pairs)


def _snake(n):
    return n.lower().replace(" ", "_")


@query("e16_service_breakdown", with_views(
    _union([(n, _snake(n)) for n in stats.fixed.SERVICES], "service"), extra=DASH_SERVICES))
def e16_service_breakdown(spark, sf):
    return breakdown.service_breakdown(customer_services(spark, sf))


@query("e17_churn_drivers", with_views(f"""
SELECT driver, category, customers, churn_rate, average_probability, {r2('abs(churn_rate - base)', 8)} AS impact_score
FROM ({_union([(n, _snake(n)) for n in stats.fixed.DRIVERS], 'driver')})
CROSS JOIN (SELECT sum(ch) / CAST(count(*) AS DOUBLE) * 100 AS base FROM f)""", extra=DASH_SERVICES))
def e17_churn_drivers(spark, sf):
    return breakdown.churn_drivers(customer_services(spark, sf)).withColumn(
        "impact_score", F.round("impact_score", 8))


@query("e18_revenue_at_risk", with_views(f"""
SELECT {r2('m')} AS monthly_revenue_at_risk, {r2('m * 12')} AS annual_revenue_at_risk, churned_customers,
       {r2('CASE WHEN n > 0 THEN m / n ELSE 0 END')} AS average_charge_at_risk
FROM (SELECT CAST(coalesce(sum(CAST(monthly_charges AS DECIMAL(28,6))) FILTER (ch = 1), 0) AS DOUBLE) AS m,
             count(monthly_charges) FILTER (ch = 1) AS n, count(*) FILTER (ch = 1) AS churned_customers FROM f)""", extra=DASH))
def e18_revenue_at_risk(spark, sf):
    return breakdown.revenue_at_risk(customer_360(spark, sf))


@query("e19_retention_opportunity", with_views(f"""
SELECT h AS high_opportunity, m AS medium_opportunity, l AS low_opportunity, h + m AS total_at_risk, {pct('h + m', 'n')} AS opportunity_rate
FROM (SELECT count(*) FILTER (pp >= 70) AS h, count(*) FILTER (pp >= 40 AND pp < 70) AS m, count(*) FILTER (pp < 40) AS l, count(*) AS n FROM f)""", extra=DASH))
def e19_retention_opportunity(spark, sf):
    return breakdown.retention_opportunity(customer_360(spark, sf))


KPI = f"""
k AS (SELECT count(*) AS total_customers, CAST(sum(ch) AS BIGINT) AS predicted_churn, {pct('sum(ch)', 'count(*)')} AS churn_rate,
  {r2('coalesce(avg(pp), 0)')} AS average_probability, count(*) FILTER (pp >= 70) AS high_risk_customers,
  {r2('coalesce(avg(tenure), 0)')} AS average_tenure, {r2('coalesce(avg(monthly_charges), 0)')} AS average_monthly_charge,
  {_money('CASE WHEN ch = 1 THEN monthly_charges END')} AS monthly_revenue_at_risk,
  {r2('CAST(coalesce(sum(CAST(CASE WHEN ch = 1 THEN monthly_charges END AS DECIMAL(28,6))), 0) AS DOUBLE) * 12')} AS annual_revenue_at_risk,
  count(*) FILTER (pp >= 70 AND monthly_charges >= (SELECT quantile_cont(monthly_charges, 0.75) FROM customer_360)) AS high_value_at_risk FROM f)"""


@query("e20_advanced_kpis", with_views("SELECT * FROM k", extra=DASH + "," + KPI))
def e20_advanced_kpis(spark, sf):
    return breakdown.advanced_kpis(stored(customer_360, spark, sf))


@query("e21_analytics_summary", with_views(" UNION ALL ".join(
    f"SELECT {i + 1} AS seq, '{name}' AS metric, CAST({c} AS DOUBLE) AS value FROM k"
    for i, (c, name) in enumerate(breakdown.KPI_NAMES.items())), extra=DASH + "," + KPI))
def e21_analytics_summary(spark, sf):
    return breakdown.analytics_summary(stored(customer_360, spark, sf))


@query("e22_prediction_summary", with_views(f"""
SELECT count(*) AS total_customers, count(*) FILTER (churn_prediction = 'Churn') AS predicted_churn,
  count(*) FILTER (churn_prediction = 'Retained') AS predicted_retained,
  {pct("count(*) FILTER (churn_prediction = 'Churn')", 'count(*)')} AS predicted_churn_rate,
  {r2('avg(risk_score)')} AS average_risk_score, {r2('avg(churn_probability)')} AS average_churn_probability,
  {', '.join(f"count(*) FILTER (risk_level = '{k.title()}') AS {k}_risk" for k in ('critical', 'high', 'medium', 'low'))} FROM scored""", extra=SCORED))
def e22_prediction_summary(spark, sf):
    return risk.prediction_summary(scored(spark, sf))


@query("e22_dashboard_summary", with_views(f"""
SELECT count(*) AS total, count(*) FILTER (churn_prediction = 'Churn') AS churn, count(*) FILTER (churn_prediction <> 'Churn') AS retained,
  count(*) FILTER (churn_prediction = 'Churn') / CAST(count(*) AS DOUBLE) * 100 AS churn_rate, {r2('avg(churn_probability)', 6)} AS avg_probability,
  count(*) FILTER (risk_level IN ('High', 'Critical')) AS high_risk, count(*) FILTER (risk_level = 'Medium') AS medium_risk,
  count(*) FILTER (risk_level = 'Low') AS low_risk FROM scored""", extra=SCORED))
def e22_dashboard_summary(spark, sf):
    return risk.dashboard_summary(scored(spark, sf)).withColumn("avg_probability", F.round("avg_probability", 6))


@query("e23_segment_summary", with_views(f"""
SELECT strategic_segment AS segment, count(*) AS customers, {r2('avg(customer_risk_score)')} AS avg_risk_score,
  {r2('avg(churn_probability)')} AS avg_churn_probability, {_money('customer_value')} AS customer_value,
  {_money('revenue_at_risk')} AS revenue_at_risk FROM intel GROUP BY 1""", extra=INTEL))
def e23_segment_summary(spark, sf):
    return risk.segment_summary(intel(spark, sf))


@query("e24_risk_summary", with_views(f"""
SELECT count(*) AS total_customers, {', '.join(f"count(*) FILTER (risk_level = '{k.title()}') AS {k}_risk" for k in ('low', 'medium', 'high', 'critical'))},
  {r2('avg(customer_risk_score)', 6)} AS average_risk_score, {r2('avg(churn_probability)', 6)} AS average_churn_probability,
  {_money('revenue_at_risk')} AS revenue_at_risk FROM intel""", extra=INTEL))
def e24_risk_summary(spark, sf):
    return risk.risk_summary(intel(spark, sf)).withColumns({
        "average_risk_score": F.round("average_risk_score", 6),
        "average_churn_probability": F.round("average_churn_probability", 6)})


BUSINESS = f"""
bs AS (SELECT count(*) AS total_customers, count(*) FILTER (risk_level = 'Critical') AS critical_customers,
  count(*) FILTER (risk_level = 'High') AS high_risk_customers, count(*) FILTER (risk_level = 'Medium') AS medium_risk_customers,
  count(*) FILTER (risk_level = 'Low') AS low_risk_customers,
  {r2('sum(coalesce(monthly_charges, 0) * churn_probability / CAST(100 AS DOUBLE))')} AS monthly_revenue_at_risk,
  {_money('revenue_at_risk')} AS total_revenue_at_risk, {r2('avg(churn_probability)')} AS average_churn_probability,
  {r2('avg(customer_risk_score)')} AS average_risk_score FROM intel)"""


@query("e25_business_summary", with_views("SELECT * FROM bs", extra=INTEL + "," + BUSINESS))
def e25_business_summary(spark, sf):
    return recommend.business_summary(intel(spark, sf))


@query("e26_value_counts", with_views(" UNION ALL ".join(
    f"SELECT '{f}' AS field, {c} AS category, count(*) AS customers FROM intel GROUP BY {c}"
    for f, c in (("segment", "strategic_segment"), ("risk_level", "risk_level"), ("prediction", "churn"))
) .replace("churn AS category", "coalesce(churn, 'Unknown') AS category"), extra=INTEL))
def e26_value_counts(spark, sf):
    d = intel(spark, sf)
    out = None
    for f in ("segment", "risk_level", "prediction"):
        part = breakdown.value_counts(d, f).select(F.lit(f).alias("field"), "category", "customers")
        out = part if out is None else out.unionByName(part)
    return out


@query("e27_probability_histogram", with_views("""
SELECT CAST(b AS INTEGER) AS bin, b * CAST(5 AS DOUBLE) AS low, (b + 1) * CAST(5 AS DOUBLE) AS high, count(*) AS customers
FROM (SELECT least(floor(pp / CAST(5 AS DOUBLE)), 19) AS b FROM f WHERE pp IS NOT NULL) GROUP BY b""", extra=DASH))
def e27_probability_histogram(spark, sf):
    return breakdown.probability_histogram(customer_360(spark, sf))


def _exposure(hit, source):
    return f"""SELECT {r2('t')} AS total_monthly_charges, {r2('r')} AS monthly_revenue_at_risk, {pct('r', 't')} AS exposure_percentage
      FROM (SELECT CAST(sum(CAST(monthly_charges AS DECIMAL(28,6))) AS DOUBLE) AS t,
        CAST(coalesce(sum(CAST(monthly_charges AS DECIMAL(28,6))) FILTER ({hit}), 0) AS DOUBLE) AS r FROM {source})"""


@query("e28_exposure", with_views(_exposure("churn_prediction = 'Churn'", "scored"), extra=SCORED))
def e28_exposure(spark, sf):
    return breakdown.exposure(scored(spark, sf))


@query("e28_exposure_by_level", with_views(_exposure("risk_level IN ('High', 'Critical')", "intel"), extra=INTEL))
def e28_exposure_by_level(spark, sf):
    return breakdown.exposure(intel(spark, sf))


def _numbered(items):
    """(condition, text) list -> (seq, insight) rows over a one-row table `r`."""
    texts = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items)
    return (f"SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS seq, insight FROM "
            f"(SELECT unnest([{texts}]) AS insight, generate_subscripts([{texts}], 1) AS i FROM r) WHERE insight IS NOT NULL")


def _f(x, digits=1, comma=False):
    spec = "{:,.%df}" % digits if comma else "{:.%df}" % digits
    return f"format('{spec}', {r2(x, digits)})"


def _n(x):
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


@query("e29_executive_insights", with_views(_numbered([
    ("pm IS NOT NULL", f"concat('Average churn probability is ', {_f('pm')}, '% across ', {_n('n')}, ' customers.')"),
    ("hp > 0", f"concat({_n('hp')}, ' customers have a churn probability of 70% or higher and should receive priority retention attention.')"),
    ("c > 0", f"concat({_f('c / CAST(n AS DOUBLE) * 100')}, '% of customers are currently predicted to churn.')"),
    ("hr > 0", f"concat({_n('hr')}, ' customers are classified as high or critical risk.')"),
    ("true", f"concat(tc, ' customers show the highest contract-level churn rate at ', {_f('tr')}, '%.')"),
    ("tm IS NOT NULL", f"concat('Average customer tenure is ', {_f('tm')}, ' months.')"),
    ("cm IS NOT NULL", f"concat('Average monthly customer charge is ', {_f('cm', 2, True)}, '.')")]), extra=INTEL + f""",
f AS (SELECT *, {CHURNED} AS ch FROM intel),
top AS (SELECT contract AS tc, sum(ch) / CAST(count(*) AS DOUBLE) * 100 AS tr FROM f GROUP BY contract ORDER BY tr DESC, tc LIMIT 1),
r AS (SELECT avg(churn_probability) AS pm, count(*) AS n, count(*) FILTER (churn_probability >= 70) AS hp, sum(ch) AS c,
  count(*) FILTER (risk_level IN ('High', 'Critical')) AS hr, avg(tenure) AS tm, avg(monthly_charges) AS cm, any_value(tc) AS tc, any_value(tr) AS tr
  FROM f CROSS JOIN top)"""))
def e29_executive_insights(spark, sf):
    return breakdown.executive_insights(intel(spark, sf))


@query("e29_eda_insights", with_views(_numbered([
    ("cr >= 30", f"concat('Overall churn is high at ', {_f('cr')}, '%. Retention should be treated as a major business priority.')"),
    ("cr >= 20 AND cr < 30", f"concat('Overall churn is ', {_f('cr')}, '%, indicating a meaningful retention opportunity.')"),
    ("cr < 20", f"concat('Overall churn is relatively contained at ', {_f('cr')}, '%.')"),
    ("true", f"concat('The highest observed churn rate is ', {_f('kr')}, '% for ', kn, '.')"),
    ("true", f"concat('The tenure group with the highest churn rate is ', tn, ' at ', {_f('tr')}, '%.')")]), extra=LABELLED + f""",
k AS ({_by_column('contract')}), t AS ({_tenure_bands_sql(stats.fixed.TENURE_BANDS_LONG)}),
r AS (SELECT {pct('count(*) FILTER (yy = 1)', 'count(yy)')} AS cr, (SELECT category FROM k ORDER BY churn_rate DESC, category DESC LIMIT 1) AS kn,
  (SELECT max(churn_rate) FROM k) AS kr, (SELECT tenure_group FROM t ORDER BY churn_rate DESC, band_order LIMIT 1) AS tn,
  (SELECT max(churn_rate) FROM t) AS tr FROM y)"""))
def e29_eda_insights(spark, sf):
    return stats.eda_insights(stored(customer_360, spark, sf))


@query("e29_executive_recommendations", with_views(_numbered([
    ("critical_customers > 0", f"concat('Prioritize immediate outreach to ', {_n('critical_customers')}, ' critical-risk customers.')"),
    ("high_risk_customers > 0", f"concat('Launch targeted retention campaigns for ', {_n('high_risk_customers')}, ' high-risk customers.')"),
    ("monthly_revenue_at_risk > 0", f"concat('Focus retention resources on the estimated ', {_f('monthly_revenue_at_risk', 2, True)}, ' monthly revenue at risk.')"),
    ("average_churn_probability >= 60", "'Overall churn probability is elevated; increase proactive customer engagement.'"),
    ("average_churn_probability >= 35 AND average_churn_probability < 60", "'Maintain active churn monitoring and segment customers by behavioral risk.'"),
    ("average_churn_probability < 35", "'Overall churn risk is relatively controlled; focus on loyalty and customer-value expansion.'")]),
    extra=INTEL + "," + BUSINESS + ", r AS (SELECT * FROM bs)"))
def e29_executive_recommendations(spark, sf):
    return recommend.executive_recommendations(intel(spark, sf))


# --- joins and reshaping -------------------------------------------------------------------------

@query("j1_action_plan", with_views(f"""
SELECT retention_priority AS priority, count(*) AS customers, CAST(sum(CAST(revenue_at_risk AS DECIMAL(28,6))) AS DOUBLE) AS revenue_at_risk,
  {r2('avg(churn_probability)', 6)} AS average_churn_probability,
  CASE retention_priority WHEN 'Immediate' THEN 1 WHEN 'High' THEN 2 WHEN 'Monitor' THEN 3 WHEN 'Low' THEN 4 ELSE 99 END AS sort_order
FROM recs GROUP BY 1""", extra=RECS))
def j1_action_plan(spark, sf):
    return recommend.action_plan(recs(spark, sf)).withColumn(
        "average_churn_probability", F.round("average_churn_probability", 6))


@query("j2_stacked_breakdowns", with_views(
    _union([("Gender", "gender"), ("Contract", "contract")], "attribute"), extra=DASH))
def j2_stacked_breakdowns(spark, sf):
    d = customer_360(spark, sf)
    parts = [breakdown.category_breakdown(d, [n]).withColumn("attribute", F.lit(n)) for n in ("Gender", "Contract")]
    return parts[0].unionByName(parts[1])


@query("j3_row_means", with_views("""
SELECT customer_id, list_avg([CAST(usage_events AS DOUBLE), CAST(support_tickets AS DOUBLE), CAST(tenure AS DOUBLE)]) AS row_mean,
  (coalesce(CAST(usage_events AS DOUBLE), 0) * CAST(1.5 AS DOUBLE) + coalesce(CAST(tenure AS DOUBLE), 0) * CAST(0.5 AS DOUBLE)) / CAST(2 AS DOUBLE) AS weighted_mean
FROM customer_360"""))
def j3_row_means(spark, sf):
    from ebbtide.functions import columns as X
    d = customer_360(spark, sf)
    n = {c: X.number(d, c) for c in ("usage_events", "support_tickets", "tenure")}
    return d.select("customer_id", X.mean_of(n.values()).alias("row_mean"),
                    X.weighted_mean([n["usage_events"], n["tenure"]], [1.5, 0.5]).alias("weighted_mean"))


LEVELS = ["Bank transfer", "Credit card", "Electronic check", "Mailed check"]


@query("j5_one_hot", with_views(
    "SELECT customer_id, " + ", ".join(f"CASE WHEN payment_method = '{v}' THEN 1 ELSE 0 END AS \"payment_method_{v}\"" for v in LEVELS)
    + " FROM customer_360"))
def j5_one_hot(spark, sf):
    d = stored(customer_360, spark, sf).select("customer_id", "payment_method")
    return breakdown.one_hot(d, ["payment_method"], breakdown.distinct_levels(d, ["payment_method"]))


@query("j5_one_hot_long", with_views("""
SELECT customer_id, concat('payment_method_', payment_method) AS feature FROM customer_360
UNION ALL SELECT customer_id, concat('contract_', contract) FROM customer_360"""))
def j5_one_hot_long(spark, sf):
    return breakdown.one_hot_long(customer_360(spark, sf), ["payment_method", "contract"], "customer_id")


# --- explorer ---------------------------------------------------------------------------------------

@query("d1_apply_filters", with_views("""
SELECT customer_id, contract, gender, senior_citizen FROM customer_360
WHERE contract IN ('One year', 'Two year') AND gender = 'Female' AND CAST(senior_citizen AS VARCHAR) = '0'"""))
def d1_apply_filters(spark, sf):
    return explore.apply_filters(customer_360(spark, sf), {
        "Contract": ["One year", "Two year"], "Gender": "Female", "senior-citizen": 0,
        "Payment Method": "All", "Internet Service": None, "No such column": "x"}).select(
        "customer_id", "contract", "gender", "senior_citizen")


TEXTS = ["customer_key", "customer_id", "gender", "senior_citizen", "plan_segment", "internet_service", "contract",
         "payment_method", "tenure", "recency_months", "usage_events", "support_tickets", "churn"]


# Numbers have no text form with "month-to" in it, so how they are written does not matter here.
@query("d2_search", with_views(
    "SELECT customer_id, contract FROM customer_360 WHERE "
    + " OR ".join(f"coalesce(contains(lower(CAST({c} AS VARCHAR)), 'month-to'), false)" for c in [*TEXTS, *ALL_NUMERIC])))
def d2_search(spark, sf):
    return explore.search(customer_360(spark, sf), " month-TO ").select("customer_id", "contract")


CHOSEN = "risk_level IN ('High', 'Critical') AND contract = 'Month-to-month' AND retention_priority IN ('High', 'Immediate')"


@query("d3_select_any", with_views(f"SELECT customer_id, risk_level, contract, retention_priority FROM intel WHERE {CHOSEN}", extra=INTEL))
def d3_select_any(spark, sf):
    return explore.select_any(intel(spark, sf), risk_level=["High", "Critical"], contract=["Month-to-month"],
                              priority=["High", "Immediate"], predicted=[]).select(
        "customer_id", "risk_level", "contract", "retention_priority")


@query("d4_select_ranges", with_views("""
SELECT customer_id, churn_probability, customer_risk_score FROM intel
WHERE churn_probability BETWEEN 20 AND 80 AND customer_risk_score BETWEEN 30 AND 70 AND monthly_charges BETWEEN 1000 AND 40000""", extra=INTEL))
def d4_select_ranges(spark, sf):
    return explore.select_ranges(intel(spark, sf), probability=(20, 80), risk_score=(30, 70),
                                 monthly_charges=(1000, 40000)).select(
        "customer_id", "churn_probability", "customer_risk_score")


@query("d5_filter_choices", with_views("""
SELECT 'risk_level' AS field, risk_level AS choice FROM intel GROUP BY 2 UNION ALL SELECT 'contract', contract FROM intel GROUP BY 2
UNION ALL SELECT 'priority', retention_priority FROM intel GROUP BY 2""", extra=INTEL))
def d5_filter_choices(spark, sf):
    return explore.filter_choices(intel(spark, sf))


@query("d5_filter_bounds", with_views("""
SELECT 'probability' AS field, min(churn_probability) AS low, max(churn_probability) AS high FROM intel
UNION ALL SELECT 'risk_score', min(customer_risk_score), max(customer_risk_score) FROM intel
UNION ALL SELECT 'monthly_charges', min(monthly_charges), max(monthly_charges) FROM intel""", extra=INTEL))
def d5_filter_bounds(spark, sf):
    return explore.filter_bounds(intel(spark, sf))


@query("d6_explorer_summary", with_views(f"""
SELECT total, matched, {pct('matched', 'total')} AS match_rate, high_risk FROM (SELECT count(*) AS total,
  count(*) FILTER (contract = 'Month-to-month' AND churn_probability BETWEEN 25 AND 100) AS matched,
  count(*) FILTER (contract = 'Month-to-month' AND churn_probability BETWEEN 25 AND 100 AND risk_level IN ('High', 'Critical')) AS high_risk FROM intel)""", extra=INTEL))
def d6_explorer_summary(spark, sf):
    return explore.explorer_summary(intel(spark, sf), choices={"contract": ["Month-to-month"]},
                                    ranges={"probability": (25, 100)})


@query("d7_high_risk_customers", with_views(
    "SELECT customer_id, customer_risk_score FROM intel WHERE customer_risk_score >= 60", extra=INTEL))
def d7_high_risk_customers(spark, sf):
    return explore.high_risk_customers(intel(spark, sf)).select("customer_id", "customer_risk_score")


@query("d7_priority_top200", with_views(
    "SELECT customer_id, customer_risk_score FROM intel WHERE customer_risk_score >= 50 ORDER BY customer_risk_score DESC, customer_id LIMIT 200", extra=INTEL))
def d7_priority_top200(spark, sf):
    return explore.high_risk_customers(intel(spark, sf), 50, limit=200, tie_break="customer_id").select(
        "customer_id", "customer_risk_score")


@query("d8_explorer_sort", with_views(
    "SELECT customer_id, customer_risk_score FROM intel ORDER BY customer_risk_score DESC NULLS LAST, customer_id LIMIT 500", extra=INTEL))
def d8_explorer_sort(spark, sf):
    return explore.sort_customers(intel(spark, sf)).select("customer_id", "customer_risk_score")


@query("d9_preview", with_views("SELECT * FROM customer_360 ORDER BY customer_key LIMIT 100"))
def d9_preview(spark, sf):
    return explore.preview(customer_360(spark, sf), 100, "customer_key")


@query("d10_customer_profile", with_views("""
SELECT unnest(['customer_id', 'contract', 'tenure', 'monthly_charges', 'churn_probability', 'risk_level', 'customer_risk_score', 'retention_priority']) AS attribute,
  unnest([customer_id, contract, CAST(tenure AS VARCHAR), CAST(monthly_charges AS VARCHAR), CAST(churn_probability AS VARCHAR), risk_level,
          CAST(customer_risk_score AS VARCHAR), retention_priority]) AS value FROM intel WHERE customer_id = 'C0000042'""", extra=INTEL))
def d10_customer_profile(spark, sf):
    return explore.customer_profile(intel(spark, sf), "C0000042")


@query("d11_existing_columns", with_views("SELECT customer_id, contract, tenure FROM customer_360"))
def d11_existing_columns(spark, sf):
    return explore.existing(customer_360(spark, sf), ["Customer ID", "Contract", "Not There", "contract", "Tenure", None])


@query("r3_high_risk_report", with_views("""
SELECT customer_id, risk_level, customer_risk_score, churn_probability, monthly_charges FROM intel
WHERE risk_level IN ('High', 'Critical')""", extra=INTEL))
def r3_high_risk_report(spark, sf):
    return explore.high_risk_report(intel(spark, sf))


@query("r3_retention_report", with_views("""
SELECT customer_id, retention_priority, risk_level, customer_risk_score, churn_probability, retention_recommendation,
       recommended_action, monthly_charges FROM recs""", extra=RECS))
def r3_retention_report(spark, sf):
    return explore.retention_report(recs(spark, sf))
