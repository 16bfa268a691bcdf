"""Risk scoring, customer value and segments.

Each scorer has a fit step (a few one-row aggregates, returned as a small profile that can be
stored as JSON) and a transform step that only adds columns. One profile scores any batch.
"""

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (
    clip, col, lower_text, mean_of, missing, money_sum, number, number_or_zero, numeric_columns,
    percent, risk_level_of_score, status, weighted_mean)
from ebbtide.functions.names import find_column, role
from ebbtide.operators.breakdown import probability_number
from ebbtide.operators.rank import (
    agg_values, dense_rank_of_scores, exact_quantiles, percentile_cutoffs, percentile_ranks)
from ebbtide.operators.roles import (
    dataset_roles, detect_customer_id, detect_target, input_columns, signal_columns)


class Profile:
    def to_json(self):
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text):
        return cls(**json.loads(text))


# --- behavioral engine ------------------------------------------------------------------------

@dataclass
class BehaviorProfile(Profile):
    signals: list = field(default_factory=list)   # [family, column, low, high, median]
    fallback: list = field(default_factory=list)  # numeric columns ranked when no signal exists


def fit_behavior(df):
    columns = input_columns(df.columns)
    skip = [c for c in (detect_target(columns, df), detect_customer_id(columns)) if c]
    families = signal_columns(columns, skip)
    chosen = [(f, c) for f in fixed.BEHAVIOR_WEIGHTS for c in families[f]]
    if not chosen:
        return BehaviorProfile([], [c for c in numeric_columns(df) if c in columns and c not in skip])
    rows = df.select(*[number(df, c).alias(f"x{i}") for i, (_, c) in enumerate(chosen)])
    got = agg_values(rows, {f"{k}{i}": f(f"x{i}") for i in range(len(chosen))
                            for k, f in (("low", F.min), ("high", F.max))})
    medians = exact_quantiles(rows, rows.columns, [0.5])
    return BehaviorProfile([[f, c, got[f"low{i}"], got[f"high{i}"], medians[f"x{i}"][0]]
                            for i, (f, c) in enumerate(chosen)])


def min_max_signal(x, low, high, median, reverse=False):
    if low is None or low == high:
        return F.lit(0.5)
    s = (F.coalesce(x, F.lit(median)) - F.lit(low)) / F.lit(high - low)
    return clip(1 - s if reverse else s, 0, 1)


def behavior_risk(df, profile):
    """Risk 0..1 as an expression, from the signals of the profile."""
    risk = F.lit(fixed.BEHAVIOR_BASE)
    for family, c, low, high, median in profile.signals:
        s = min_max_signal(number(df, c), low, high, median, family in fixed.BEHAVIOR_REVERSED)
        risk = risk + s * F.lit(fixed.BEHAVIOR_WEIGHTS[family])
    return clip(risk, 0.01, 0.99)


def mean_percentiles(df, columns, key):
    """(key, mean percentile over the numeric columns)."""
    return percentile_ranks(df, columns, key).groupBy(col(key)).agg(
        F.avg("percentile").alias("mean_percentile"))


def behavioral_scores(df, profile=None, key=None, out="risk"):
    """Adds the risk column. Without any signal the mean percentile of the numeric columns
    decides, joined back by the key (a unique column)."""
    profile = profile or fit_behavior(df)
    if profile.signals or not profile.fallback:
        return df.withColumn(out, behavior_risk(df, profile))
    key = key or detect_customer_id(df.columns)
    if key is None:
        raise ValueError("ranking rows needs a key column")
    means = mean_percentiles(df, profile.fallback, key)
    risk = clip(0.25 + F.coalesce(F.col("mean_percentile"), F.lit(0.5)) * 0.50, 0.05, 0.95)
    return df.join(means, key, "left").withColumn(out, risk).drop("mean_percentile")


# --- universal engine ---------------------------------------------------------------------------

@dataclass
class UniversalProfile(Profile):
    roles: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)   # column -> [q05, median, q95, count]
    numeric: list = field(default_factory=list)
    constant: bool = False


def numeric_score(x, scale, reverse=False):
    low, median, high, n = scale
    if n < 2 or high <= low:
        return F.lit(0.5)

    def s(v):
        t = clip((v - F.lit(low)) / F.lit(high - low), 0, 1)
        return 1 - t if reverse else t
    # Scaling keeps order and the median lies between the two cuts, so the median of the
    # scaled values is the scaled median.
    return F.coalesce(s(x), s(F.lit(median)))


def starts_word(words):
    """A listed word at the start of a word: "active" is not found in "inactive"."""
    return r"\b(" + "|".join(words) + ")"


def keyword_risk(name):
    t = lower_text(name)
    return (F.when(t.rlike(starts_word(fixed.HIGH_RISK_WORDS)), 0.75)
            .when(t.rlike(starts_word(fixed.LOW_RISK_WORDS)), 0.25).otherwise(0.5))


def _universal(df, profile):
    used = [r for r in fixed.UNIVERSAL_WEIGHTS if profile.roles.get(r)]
    if used:
        parts = [keyword_risk(profile.roles[r]) if r in fixed.UNIVERSAL_TEXT else
                 numeric_score(number(df, profile.roles[r]), profile.scales[profile.roles[r]],
                               r in fixed.UNIVERSAL_REVERSED) for r in used]
        return clip(weighted_mean(parts, [fixed.UNIVERSAL_WEIGHTS[r] for r in used]), 0, 1)
    if profile.numeric:
        return clip(mean_of(numeric_score(number(df, c), profile.scales[c])
                            for c in profile.numeric[:5]), 0, 1)
    return F.lit(0.5)


def fit_universal(df):
    profile = UniversalProfile(roles=dataset_roles(df.columns))
    profile.numeric = [c for c in numeric_columns(df) if c != profile.roles["churn"]]
    by_role = [profile.roles[r] for r in fixed.UNIVERSAL_WEIGHTS
               if r not in fixed.UNIVERSAL_TEXT and profile.roles[r]]
    columns = list(dict.fromkeys(by_role + profile.numeric[:5]))
    rows = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    cuts = exact_quantiles(rows, rows.columns, [0.05, 0.5, 0.95])
    counts = agg_values(rows, {f"x{i}": F.count(f"x{i}") for i in range(len(columns))}) if columns else {}
    profile.scales = {c: [*cuts[f"x{i}"], counts[f"x{i}"]] for i, c in enumerate(columns)}
    x = _universal(df, profile)
    low, high = df.agg(F.min(x), F.max(x)).first()
    profile.constant = low == high
    return profile


def universal_risk(df, profile):
    """Weighted mean of the signals that exist; a constant result is mixed with the first
    numeric column."""
    x = _universal(df, profile)
    if profile.constant and profile.numeric:
        first = profile.numeric[0]
        x = x * 0.65 + numeric_score(number(df, first), profile.scales[first]) * 0.35
    return x


# --- derived features -----------------------------------------------------------------------------

def fit_missing_flags(df):
    """Columns that are missing in some rows but not in all."""
    got = agg_values(df, {"n": F.count(F.lit(1)),
                          **{f"m{i}": F.count_if(missing(df, c)) for i, c in enumerate(df.columns)}})
    return [c for i, c in enumerate(df.columns) if 0 < got[f"m{i}"] < got["n"]]


def derived_features(df, flags=None):
    """Missing flags and one mean per signal family (`signal_<family>`)."""
    flags = fit_missing_flags(df) if flags is None else flags
    families = signal_columns(input_columns(df.columns))
    added = {f"{c}_missing": missing(df, c).cast("int") for c in flags}
    for family in ("tenure", "recency", "usage", "support", "payment", "spend"):
        hits = families[family][:1] if family == "recency" else families[family]
        if hits:
            added[f"signal_{family}"] = mean_of(number(df, c) for c in hits)
    return df.withColumns(added) if added else df


# --- customer intelligence -----------------------------------------------------------------------

@dataclass
class IntelligenceProfile(Profile):
    factor: float = 1.0          # brings probabilities to 0..100
    charge_low: float | None = None
    charge_high: float | None = None
    value_70: float | None = None  # value at which the percentile reaches 70, 75
    value_75: float | None = None


def contract_points(name):
    t = F.lower(col(name).cast("string"))
    return (F.when(t.rlike("two year|two-year|2 year"), 15.0)
            .when(t.rlike("one year|one-year|1 year"), 45.0)
            .when(t.contains("month"), 100.0).otherwise(50.0))


def payment_points(name):
    return F.when(F.lower(col(name).cast("string")).contains("electronic check"), 100.0).otherwise(40.0)


def customer_value(df):
    """Total charges; else monthly charge times tenure; else monthly charge; else 0."""
    total, monthly, tenure = (role(df.columns, r) for r in ("total_charges", "monthly_charges", "tenure"))
    if total:
        return F.round(number_or_zero(df, total), 2)
    if monthly and tenure:
        return F.round(number_or_zero(df, monthly) * number_or_zero(df, tenure), 2)
    return F.round(number_or_zero(df, monthly), 2) if monthly else F.lit(0.0)


def fit_intelligence(df):
    p = probability_number(df, role(df.columns, "probability"))
    charge = number(df, role(df.columns, "monthly_charges"))
    value = customer_value(df)
    got = agg_values(df, {"p": F.max(p), "low": F.min(charge), "high": F.max(charge),
                          "v_low": F.min(value), "v_high": F.max(value)})
    cuts = {70: None, 75: None}
    if got["v_low"] is not None and got["v_low"] < got["v_high"]:
        cuts = percentile_cutoffs(df.select(value.alias("v")), "v", [70, 75])
    return IntelligenceProfile(100.0 if got["p"] is not None and got["p"] <= 1.0 else 1.0,
                               got["low"], got["high"], cuts[70], cuts[75])


def customer_risk_score(df, profile, probability):
    """0..100 from probability, tenure, charge, contract and payment; absent columns add 0."""
    score = clip(F.coalesce(probability, F.lit(0.0)), 0, 100) * 0.70
    tenure, charge, contract, payment = (
        role(df.columns, r) for r in ("tenure", "monthly_charges", "contract", "payment_method"))
    if tenure:
        t = 100.0 - clip(number(df, tenure), 0, 72) / 72.0 * 100.0
        score = score + F.coalesce(t, F.lit(50.0)) * 0.10
    if charge and profile.charge_low is not None and profile.charge_high > profile.charge_low:
        c = ((number(df, charge) - F.lit(profile.charge_low))
             / F.lit(profile.charge_high - profile.charge_low) * 100.0)
        score = score + F.coalesce(c, F.lit(50.0)) * 0.08
    if contract:
        score = score + contract_points(contract) * 0.07
    if payment:
        score = score + payment_points(payment) * 0.05
    return F.round(clip(score, 0, 100), 2)


def strategic_segment(score, probability, value, profile):
    def at_least(cut):
        return value >= F.lit(cut) if cut is not None else F.lit(False)
    return (F.when((score < 30) & (probability < 30), "Loyal Customer")
            .when((score < 40) & at_least(profile.value_70), "Stable Valuable")
            .when((score < 60) & (probability < 40) & at_least(profile.value_75), "Growth Opportunity")
            .when((score >= 60) & (score < 80) & at_least(profile.value_70), "High Value At Risk")
            .when(score >= 80, "Critical Retention").otherwise("Standard Customer"))


def priority_of_score(s):
    return (F.when(s >= 80, "Immediate").when(s >= 60, "High").when(s >= 40, "Monitor").otherwise("Low"))


def customer_intelligence(df, profile=None):
    """Adds probability (0..100), risk score and level, value, segment, priority, dense rank
    and revenue at risk."""
    profile = profile or fit_intelligence(df)
    name = role(df.columns, "probability")
    p = clip(probability_number(df, name) * F.lit(profile.factor), 0, 100) if name else F.lit(0.0)
    p = F.round(F.coalesce(p, F.lit(0.0)), 2)
    out = df.withColumns({"churn_probability": p, "customer_value": customer_value(df)})
    out = out.withColumn("customer_risk_score", customer_risk_score(out, profile, F.col("churn_probability")))
    score = F.col("customer_risk_score")
    out = out.withColumns({
        "risk_level": risk_level_of_score(score),
        "strategic_segment": strategic_segment(
            score, F.col("churn_probability"), F.col("customer_value"), profile),
        "retention_priority": priority_of_score(score),
        "revenue_at_risk": F.round(F.col("customer_value") * F.col("churn_probability") / 100.0, 2)})
    return dense_rank_of_scores(out, "customer_risk_score", "priority_rank")


# --- summaries -----------------------------------------------------------------------------------

def _level_counts(df, name):
    level = F.lower(col(name).cast("string")) if name else F.lit(None)
    return {k: F.count_if(level == k) for k in ("critical", "high", "medium", "low")}


def prediction_summary(df):
    """Totals, churn rate, means and counts per risk level of scored customers."""
    predicted = status(role(df.columns, "predicted"))
    levels = _level_counts(df, role(df.columns, "risk_level"))
    row = df.agg(
        F.count("*").alias("total_customers"),
        F.count_if(predicted == "Churn").alias("predicted_churn"),
        F.count_if(predicted == "Retained").alias("predicted_retained"),
        F.avg(number(df, find_column(df.columns, ["Risk Score", "Customer Risk Score"]))).alias("s"),
        F.avg(number(df, role(df.columns, "probability"))).alias("p"),
        *[e.alias(f"{k}_risk") for k, e in levels.items()])
    return row.select(
        "total_customers", "predicted_churn", "predicted_retained",
        percent(F.col("predicted_churn"), F.col("total_customers")).alias("predicted_churn_rate"),
        F.round("s", 2).alias("average_risk_score"), F.round("p", 2).alias("average_churn_probability"),
        "critical_risk", "high_risk", "medium_risk", "low_risk")


def dashboard_summary(df):
    """Like prediction_summary, but levels are matched by word and everyone not predicted to
    churn counts as retained."""
    predicted = status(role(df.columns, "predicted"))
    risk = role(df.columns, "risk_level")
    level = F.lower(col(risk).cast("string")) if risk else F.lit("")
    row = df.agg(
        F.count("*").alias("total"), F.count_if(predicted == "Churn").alias("churn"),
        F.coalesce(F.avg(number(df, role(df.columns, "probability"))), F.lit(0.0)).alias("avg_probability"),
        F.count_if(level.rlike("high|critical")).alias("high_risk"),
        F.count_if(level.contains("medium")).alias("medium_risk"),
        F.count_if(level.contains("low")).alias("low_risk"))
    rate = F.when(F.col("total") > 0, F.col("churn") / F.col("total") * 100.0).otherwise(0.0)
    return row.select("total", "churn", (F.col("total") - F.col("churn")).alias("retained"),
                      rate.alias("churn_rate"), "avg_probability", "high_risk", "medium_risk", "low_risk")


def segment_summary(df):
    from_role = {r: number(df, role(df.columns, r)) for r in
                 ("risk_score", "probability", "customer_value", "revenue_at_risk")}
    return df.groupBy(col(role(df.columns, "segment")).alias("segment")).agg(
        F.count("*").alias("customers"),
        F.round(F.avg(from_role["risk_score"]), 2).alias("avg_risk_score"),
        F.round(F.avg(from_role["probability"]), 2).alias("avg_churn_probability"),
        F.round(money_sum(from_role["customer_value"]), 2).alias("customer_value"),
        F.round(money_sum(from_role["revenue_at_risk"]), 2).alias("revenue_at_risk")
    ).orderBy(F.desc("avg_risk_score"), "segment")


def risk_summary(df):
    levels = _level_counts(df, role(df.columns, "risk_level"))
    return df.agg(
        F.count("*").alias("total_customers"),
        *[levels[k].alias(f"{k}_risk") for k in ("low", "medium", "high", "critical")],
        F.coalesce(F.avg(number(df, role(df.columns, "risk_score"))), F.lit(0.0)).alias("average_risk_score"),
        F.coalesce(F.avg(number(df, role(df.columns, "probability"))), F.lit(0.0))
        .alias("average_churn_probability"),
        money_sum(number(df, role(df.columns, "revenue_at_risk"))).alias("revenue_at_risk"))
