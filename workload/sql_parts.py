"""CTEs shared by several checks: scored tables as plain SQL."""

from workload.views import r2

CHURN_WORDS = ("'yes','y','true','1','churn','churned','exited','exit','left','attrited','attrition',"
               "'cancelled','canceled','inactive','lost','terminated','closed'")
RETAIN_WORDS = ("'no','n','false','0','retained','retain','active','stayed','stay','not churned',"
                "'not_churned','existing','current','loyal'")
NULL_TOKENS = "'','nan','None','NULL','null','N/A','n/a','NA'"


def label(c):
    return (f"CASE WHEN lower(trim({c})) IN ({CHURN_WORDS}) THEN 1 "
            f"WHEN lower(trim({c})) IN ({RETAIN_WORDS}) THEN 0 END")


def tokens(c):
    return f"CASE WHEN trim({c}) NOT IN ({NULL_TOKENS}) THEN trim({c}) END"


def number(c):
    return f"TRY_CAST(trim(regexp_replace({c}, '[,$₹€£]', '', 'g')) AS DOUBLE)"


def pct(part, whole, digits=2):
    return r2(f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0 END", digits)


def signal(c, reverse=False):
    s = (f"(coalesce(CAST(u.{c} AS DOUBLE), s.{c}_md) - s.{c}_lo) / (s.{c}_hi - s.{c}_lo)")
    return f"(1 - {s})" if reverse else f"({s})"


def stats(cols, source):
    parts = ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_lo, CAST(max({c}) AS DOUBLE) AS {c}_hi, "
                      f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_md" for c in cols)
    return f"SELECT {parts} FROM {source}"


LEVEL_P = ("CASE WHEN {p} >= 0.75 THEN 'Critical' WHEN {p} >= 0.5 THEN 'High' "
           "WHEN {p} >= 0.25 THEN 'Medium' WHEN {p} IS NOT NULL THEN 'Low' END")
LEVEL_S = ("CASE WHEN {s} <= 29.99 THEN 'Low' WHEN {s} <= 59.99 THEN 'Medium' "
           "WHEN {s} <= 79.99 THEN 'High' WHEN {s} IS NOT NULL THEN 'Critical' END")

# Behavioral engine over the unlabelled view.
SCORED = f"""
unlabelled AS (SELECT * EXCLUDE (churn, churn_probability, customer_key) FROM customer_360),
sg AS ({stats(['recency_months', 'usage_events', 'tenure', 'support_tickets'], 'unlabelled')}),
risky AS (
  SELECT u.*, least(greatest(CAST(0.45 AS DOUBLE) + {signal('recency_months')} * CAST(0.25 AS DOUBLE)
    + {signal('usage_events', True)} * CAST(0.15 AS DOUBLE) + {signal('tenure', True)} * CAST(0.10 AS DOUBLE)
    + {signal('support_tickets')} * CAST(0.15 AS DOUBLE), CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE)) AS risk
  FROM unlabelled u CROSS JOIN sg s),
scored AS (
  SELECT * EXCLUDE (risk), CASE WHEN risk >= 0.5 THEN 'Churn' ELSE 'Retained' END AS churn_prediction,
    {r2('risk * CAST(100 AS DOUBLE)')} AS churn_probability, {r2('risk * CAST(100 AS DOUBLE)')} AS risk_score,
    {LEVEL_P.format(p='risk')} AS risk_level, 'Behavioral Risk Engine' AS prediction_method
  FROM risky)"""


def intelligence(source, name, factor):
    """Customer intelligence over a table with probability, tenure, charges, contract, payment."""
    return f"""
{name}_p AS (
  SELECT * EXCLUDE (churn_probability),
    {r2(f'coalesce(CASE WHEN churn_probability * {factor} < 0 THEN 0 WHEN churn_probability * {factor} > 100 THEN 100 ELSE churn_probability * {factor} END, CAST(0 AS DOUBLE))')} AS churn_probability,
    {r2('coalesce(total_charges, CAST(0 AS DOUBLE))')} AS customer_value FROM {source}),
{name}_m AS (SELECT min(monthly_charges) AS lo, max(monthly_charges) AS hi, count(*) AS n FROM {name}_p),
{name}_s AS (
  SELECT x.*, {r2('''least(greatest(churn_probability * CAST(0.70 AS DOUBLE)
     + coalesce(CAST(100 AS DOUBLE) - CAST(CASE WHEN tenure < 0 THEN 0 WHEN tenure > 72 THEN 72 ELSE tenure END AS DOUBLE)
        / CAST(72 AS DOUBLE) * CAST(100 AS DOUBLE), CAST(50 AS DOUBLE)) * CAST(0.10 AS DOUBLE)
     + coalesce((monthly_charges - m.lo) / (m.hi - m.lo) * CAST(100 AS DOUBLE), CAST(50 AS DOUBLE)) * CAST(0.08 AS DOUBLE)
     + CAST(CASE WHEN regexp_matches(lower(contract), 'two year|two-year|2 year') THEN 15
            WHEN regexp_matches(lower(contract), 'one year|one-year|1 year') THEN 45
            WHEN contains(lower(contract), 'month') THEN 100 ELSE 50 END AS DOUBLE) * CAST(0.07 AS DOUBLE)
     + CAST(CASE WHEN contains(lower(payment_method), 'electronic check') THEN 100 ELSE 40 END AS DOUBLE) * CAST(0.05 AS DOUBLE),
     CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE))''')} AS customer_risk_score,
    (rank() OVER (ORDER BY customer_value) - 1 + (count(*) OVER (PARTITION BY customer_value) + 1) / CAST(2 AS DOUBLE))
      / m.n * 100 AS value_percentile
  FROM {name}_p x CROSS JOIN {name}_m m),
{name} AS (
  SELECT * EXCLUDE (value_percentile {', risk_level' if source == 'scored' else ''}),
    {LEVEL_S.format(s='customer_risk_score')} AS risk_level,
    CASE WHEN customer_risk_score < 30 AND churn_probability < 30 THEN 'Loyal Customer'
         WHEN customer_risk_score < 40 AND value_percentile >= 70 THEN 'Stable Valuable'
         WHEN customer_risk_score < 60 AND churn_probability < 40 AND value_percentile >= 75 THEN 'Growth Opportunity'
         WHEN customer_risk_score >= 60 AND customer_risk_score < 80 AND value_percentile >= 70 THEN 'High Value At Risk'
         WHEN customer_risk_score >= 80 THEN 'Critical Retention' ELSE 'Standard Customer' END AS strategic_segment,
    CASE WHEN customer_risk_score >= 80 THEN 'Immediate' WHEN customer_risk_score >= 60 THEN 'High'
         WHEN customer_risk_score >= 40 THEN 'Monitor' ELSE 'Low' END AS retention_priority,
    {r2('customer_value * churn_probability / CAST(100 AS DOUBLE)')} AS revenue_at_risk,
    dense_rank() OVER (ORDER BY customer_risk_score DESC) AS priority_rank
  FROM {name}_s)"""


INTEL = intelligence("customer_360", "intel", "CAST(100 AS DOUBLE)")
CHAIN = SCORED + "," + intelligence("scored", "chain", "CAST(1 AS DOUBLE)")


def recommended(source, name):
    from ebbtide.functions.fixed import ACTIONS
    rules = [
        ("risk_level = 'Critical' AND contains(lower(contract), 'month')", "critical_monthly"),
        ("risk_level = 'Critical'", "critical"),
        ("risk_level = 'High' AND contains(lower(payment_method), 'electronic check')", "high_payment"),
        ("risk_level = 'High' AND coalesce(tenure, 0) <= 6", "high_early"),
        ("risk_level = 'High'", "high"),
        ("risk_level = 'Medium' AND contains(lower(strategic_segment), 'growth')", "medium_growth"),
        ("risk_level = 'Medium'", "medium"),
        ("contains(lower(strategic_segment), 'loyal') OR contains(lower(strategic_segment), 'stable')", "low_loyal")]

    def case(i):
        return ("CASE " + " ".join(f"WHEN {c} THEN '{ACTIONS[a][i]}'" for c, a in rules)
                + f" ELSE '{ACTIONS['low'][i]}' END")
    return f"""
{name} AS (
  SELECT * EXCLUDE (retention_priority), {case(0)} AS retention_priority, {case(1)} AS recommended_action,
    {case(2)} AS retention_recommendation,
    {r2('''least(greatest(customer_risk_score * CAST(0.70 AS DOUBLE) + revenue_at_risk / max(revenue_at_risk) OVER ()
       * CAST(100 AS DOUBLE) * CAST(0.30 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE))''')} AS retention_urgency_score,
    CASE {case(0)} WHEN 'Immediate' THEN 'Personal Outreach' WHEN 'High' THEN 'Targeted Campaign'
         WHEN 'Monitor' THEN 'Email / In-App' ELSE 'Standard Engagement' END AS recommended_channel
  FROM {source})"""


RECS = INTEL + "," + recommended("intel", "recs")
CHAIN_RECS = CHAIN + "," + recommended("chain", "chain_recs")
