"""Retention actions and business summaries."""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import clip, col, exact, money_sum, number, number_or_zero
from ebbtide.functions.names import find_column, role
from ebbtide.operators.risk import _level_counts
from ebbtide.operators.stats import sentences


def _lower(df, name):
    return F.lower(F.coalesce(col(name).cast("string"), F.lit(""))) if name else F.lit("")


def action(df):
    """Struct (priority, action, recommendation) by risk level, contract, payment, tenure and
    segment. A missing tenure counts as 0 months."""
    risk, segment, contract, payment = (
        _lower(df, role(df.columns, r)) for r in ("risk_level", "segment", "contract", "payment_method"))
    tenure = number_or_zero(df, role(df.columns, "tenure"))

    def act(name):
        p, a, r = fixed.ACTIONS[name]
        return F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(r).alias("recommendation"))
    return (F.when((risk == "critical") & contract.contains("month"), act("critical_monthly"))
            .when(risk == "critical", act("critical"))
            .when((risk == "high") & payment.contains("electronic check"), act("high_payment"))
            .when((risk == "high") & (tenure <= 6), act("high_early"))
            .when(risk == "high", act("high"))
            .when((risk == "medium") & segment.contains("growth"), act("medium_growth"))
            .when(risk == "medium", act("medium"))
            .when(segment.contains("loyal") | segment.contains("stable"), act("low_loyal"))
            .otherwise(act("low")))


def revenue_at_risk_column(df, factor):
    value, p = role(df.columns, "customer_value"), role(df.columns, "probability")
    if not (value and p):
        return F.lit(0.0)
    return F.round(number_or_zero(df, value) * (number_or_zero(df, p) * F.lit(float(factor))) / 100.0, 2)


def channel(priority):
    expr = None
    for p, name in fixed.CHANNELS.items():
        expr = F.when(priority == p, name) if expr is None else expr.when(priority == p, name)
    return expr.otherwise(fixed.OTHER_CHANNEL)


def recommendations(df, highest_at_risk=None):
    """Adds priority, action, recommendation, urgency and channel. The largest revenue at risk
    is one fitted number; without it a one-row aggregate supplies it."""
    out = df.withColumn("__a", action(df))
    if role(df.columns, "revenue_at_risk") is None:
        p = role(df.columns, "probability")
        top = df.agg(F.max(number_or_zero(df, p))).first()[0] if p else None
        out = out.withColumn("revenue_at_risk",
                             revenue_at_risk_column(df, 100.0 if top is not None and top <= 1 else 1.0))
    score = role(out.columns, "risk_score")
    at_risk = number_or_zero(out, role(out.columns, "revenue_at_risk"))
    if score is None:
        urgency = F.lit(0.0)
    else:
        if highest_at_risk is None:
            highest_at_risk = out.agg(F.max(at_risk)).first()[0] or 0.0
        value = at_risk / F.lit(highest_at_risk) * 100.0 if highest_at_risk > 0 else F.lit(0.0)
        urgency = F.round(clip(number_or_zero(out, score) * 0.70 + value * 0.30, 0, 100), 2)
    return out.withColumns({
        "retention_priority": F.col("__a")["priority"], "recommended_action": F.col("__a")["action"],
        "retention_recommendation": F.col("__a")["recommendation"],
        "retention_urgency_score": urgency,
        "recommended_channel": channel(F.col("__a")["priority"])}).drop("__a")


def business_summary(df):
    """Counts per level, revenue at risk and means in one pass. Both scalings of the monthly
    exposure are summed; the largest probability of the same pass picks the right one."""
    p, score = role(df.columns, "probability"), role(df.columns, "risk_score")
    monthly = find_column(df.columns, ["Monthly Charges"])
    x = number_or_zero(df, p)
    exposure = number_or_zero(df, monthly) * x / 100.0 if monthly and p else F.lit(0.0)
    levels = _level_counts(df, role(df.columns, "risk_level"))
    row = df.agg(
        F.count("*").alias("total_customers"),
        *[levels[k].alias(n) for k, n in (("critical", "critical_customers"), ("high", "high_risk_customers"),
                                          ("medium", "medium_risk_customers"), ("low", "low_risk_customers"))],
        F.max(x).alias("__max"), F.sum(exact(exposure, 10)).cast("double").alias("__m"),
        money_sum(number_or_zero(df, role(df.columns, "revenue_at_risk"))).alias("__r"),
        F.avg(x).alias("__p"), F.avg(number_or_zero(df, score)).alias("__s"))

    def two(c):
        return F.round(F.coalesce(c, F.lit(0.0)), 2)
    scaled = F.when(F.col("__max") <= 1, F.col("__m") * 100.0).otherwise(F.col("__m"))
    return row.select(
        "total_customers", "critical_customers", "high_risk_customers", "medium_risk_customers",
        "low_risk_customers", two(scaled).alias("monthly_revenue_at_risk"),
        two(F.col("__r")).alias("total_revenue_at_risk"),
        two(F.col("__p")).alias("average_churn_probability"), two(F.col("__s")).alias("average_risk_score"))


def action_plan(df):
    """Customers, revenue at risk and mean probability per priority, most urgent first."""
    priority = col(role(df.columns, "priority"))
    order = F.coalesce(F.nullif(F.array_position(
        F.array(*[F.lit(p) for p in fixed.PRIORITY_ORDER]), F.col("priority")), F.lit(0)), F.lit(99))
    return (df.groupBy(priority.alias("priority")).agg(
        F.count("*").alias("customers"),
        money_sum(number(df, role(df.columns, "revenue_at_risk"))).alias("revenue_at_risk"),
        F.avg(number(df, role(df.columns, "probability"))).alias("average_churn_probability"))
        .withColumn("sort_order", order.cast("int")).orderBy("sort_order", "priority"))


def executive_recommendations(df):
    words = fixed.EXECUTIVE_RECOMMENDATIONS
    c = F.col
    mean = c("average_churn_probability")
    return sentences(business_summary(df).where(c("total_customers") > 0), [
        (c("critical_customers") > 0, F.format_string(words["critical"], c("critical_customers"))),
        (c("high_risk_customers") > 0, F.format_string(words["high"], c("high_risk_customers"))),
        (c("monthly_revenue_at_risk") > 0, F.format_string(words["revenue"], c("monthly_revenue_at_risk"))),
        (mean >= 60, F.lit(words["elevated"])),
        ((mean >= 35) & (mean < 60), F.lit(words["active"])),
        (mean < 35, F.lit(words["calm"]))])
