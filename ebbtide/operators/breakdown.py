"""Dashboard breakdowns and KPI records over a scored or labelled customer table.

Functions that show probabilities take the factor that brings them to 0..100; without it one
small job reads the range of the column.
"""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (
    band, category, churn_mask, clip, col, is_high_risk, long_form, money_sum, number,
    parse_number, percent, status)
from ebbtide.functions.names import find_column, role
from ebbtide.operators.rank import agg_values, exact_quantiles
from ebbtide.operators.stats import all_bands, sentences


def probability_number(df, name):
    """Probability as number; a trailing % sign is accepted."""
    if name is not None and dict(df.dtypes)[name] == "string":
        return parse_number(F.regexp_replace(col(name), "%", ""))
    return number(df, name)


def probability_factor(df):
    """100 when every probability lies in 0..1, else 1. Belongs to a fitted profile: a later
    batch must not be scaled by its own range."""
    name = role(df.columns, "probability")
    if name is None:
        return 1.0
    p = probability_number(df, name)
    low, high = df.agg(F.min(p), F.max(p)).first()
    return 100.0 if low is not None and low >= 0 and high <= 1 else 1.0


def probability(df, factor):
    name = role(df.columns, "probability")
    return clip(probability_number(df, name) * F.lit(float(factor)), 0, 100)


def _facts(df, factor, *extra):
    """The few columns a breakdown needs: churn flag, probability and what is asked for."""
    factor = probability_factor(df) if factor is None else factor
    return df.select(
        F.when(status(role(df.columns, "prediction")) == "Churn", 1).otherwise(0).alias("__churn"),
        probability(df, factor).alias("__p"), *extra)


MEASURES = ["customers", "churned_customers", "average_probability"]


def _measures():
    return [F.count("*").alias("customers"), F.sum("__churn").alias("churned_customers"),
            F.avg("__p").alias("average_probability")]


def _rates():
    return [F.round(F.coalesce(F.col("average_probability"), F.lit(0.0)), 2).alias("average_probability"),
            percent(F.col("churned_customers"), F.col("customers")).alias("churn_rate")]


def contract_breakdown(df, factor=None):
    """Customers, churn and monthly charges of churned customers by contract."""
    contract, charge = role(df.columns, "contract"), role(df.columns, "monthly_charges")
    x = number(df, charge) if charge else F.lit(0.0)
    rows = _facts(df, factor, col(contract).alias("contract"), x.alias("__charge"))
    return rows.groupBy("contract").agg(
        *_measures(), money_sum(F.when(F.col("__churn") == 1, F.col("__charge"))).alias("r")).select(
        "contract", "customers", "churned_customers", *_rates(), F.round("r", 2).alias("revenue_at_risk")
    ).orderBy(F.desc("churn_rate"), "contract")


def tenure_breakdown(df, factor=None):
    rows = _facts(df, factor, number(df, role(df.columns, "tenure")).alias("t")).where(F.col("t").isNotNull())
    grouped = rows.groupBy(band(F.col("t"), fixed.TENURE_BANDS_DASHBOARD).alias("band")).agg(*_measures())
    return all_bands(grouped, [b for _, b in fixed.TENURE_BANDS_DASHBOARD], MEASURES).select(
        "band_order", F.col("band").alias("tenure_group"), "customers", "churned_customers", *_rates()
    ).orderBy("band_order")


def charge_breakdown(df, factor=None):
    """Quartiles of the monthly charge; one band when quartile edges coincide."""
    charge = role(df.columns, "monthly_charges")
    rows = _facts(df, factor, number(df, charge).alias("x")).where(F.col("x").isNotNull())
    edges = exact_quantiles(rows.select("x"), ["x"], [0, 0.25, 0.5, 0.75, 1])["x"]
    if edges[0] is None:
        bands = [(None, "All Customers")]
    elif len(set(edges)) < 5:
        bands = [(edges[4], "All Customers")]
    else:
        bands = list(zip(edges[1:4], fixed.CHARGE_BANDS[:3])) + [(None, fixed.CHARGE_BANDS[3])]
    name = band(F.col("x"), bands) if edges[0] is not None else F.lit(bands[0][1])
    grouped = rows.groupBy(name.alias("band")).agg(*_measures(), F.avg("x").alias("average_charge"))
    return all_bands(grouped, [b for _, b in bands], MEASURES + ["average_charge"]).select(
        "band_order", F.col("band").alias("charge_band"), "customers", "churned_customers", *_rates(),
        F.round("average_charge", 2).alias("average_monthly_charge")).orderBy("band_order")


def category_breakdown(df, names, factor=None):
    """Breakdown by the first of the named columns that exists."""
    c = find_column(df.columns, names)
    if c is None:
        return None
    return _facts(df, factor, category(c).alias("category")).groupBy("category").agg(*_measures()).select(
        "category", "customers", "churned_customers", *_rates()).orderBy(F.desc("churn_rate"), "category")


def payment_breakdown(df, factor=None):
    return category_breakdown(df, fixed.RESULT_ALIASES["payment_method"], factor)


def internet_breakdown(df, factor=None):
    return category_breakdown(df, fixed.RESULT_ALIASES["internet_service"], factor)


def gender_breakdown(df, factor=None):
    return category_breakdown(df, fixed.RESULT_ALIASES["gender"], factor)


def yes_no(c):
    return F.when(c.isin("1", "1.0"), "Yes").when(c.isin("0", "0.0"), "No").otherwise(c)


def senior_breakdown(df, factor=None):
    out = category_breakdown(df, fixed.RESULT_ALIASES["senior_citizen"], factor)
    return out.withColumn("category", yes_no(F.col("category")))


def _many(df, named, factor, name):
    """One scan and one grouping for several category columns."""
    found = [(n, find_column(df.columns, [n])) for n in named]
    pairs = F.array(*[F.struct(F.lit(n).alias(name), category(c).alias("category")) for n, c in found if c])
    rows = _facts(df, factor, pairs.alias("pairs"))
    return rows.select("__churn", "__p", F.inline("pairs")).groupBy(name, "category").agg(*_measures())


def service_breakdown(df, factor=None):
    return _many(df, fixed.SERVICES, factor, "service").select(
        "service", "category", "customers", "churned_customers", *_rates()).orderBy(
        "service", F.desc("churn_rate"), "category")


def churn_drivers(df, factor=None):
    """Distance of every category's churn rate from the overall rate, largest first. All
    customers fall into one category of each driver, so the overall rate comes from the groups
    of the first driver: no second scan and no join."""
    groups = _many(df, fixed.DRIVERS, factor, "driver")
    first = next(n for n in fixed.DRIVERS if find_column(df.columns, [n]))
    one = groups.where(F.col("driver") == first).agg(
        (F.sum("churned_customers") / F.sum("customers") * 100.0).alias("b")).scalar()
    return groups.select("driver", "category", "customers", *_rates()).withColumn(
        "impact_score", F.abs(F.col("churn_rate") - one)).orderBy(
        F.desc("impact_score"), "driver", "category")


def _risk_measures(df):
    churned = churn_mask(role(df.columns, "prediction"))
    charge = number(df, role(df.columns, "monthly_charges"))
    return {"churned_customers": F.count_if(churned),
            "__sum": money_sum(F.when(churned, charge)),
            "__n": F.count(F.when(churned, charge))}


def revenue_at_risk(df):
    row = df.agg(*[e.alias(k) for k, e in _risk_measures(df).items()])
    return row.select(
        F.round("__sum", 2).alias("monthly_revenue_at_risk"),
        F.round(F.col("__sum") * 12, 2).alias("annual_revenue_at_risk"), "churned_customers",
        F.round(F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(0.0), 2)
        .alias("average_charge_at_risk"))


def retention_opportunity(df, factor=None):
    p = F.col("__p")
    row = _facts(df, factor).agg(
        F.count("*").alias("n"), F.count_if(p >= 70).alias("high_opportunity"),
        F.count_if((p >= 40) & (p < 70)).alias("medium_opportunity"),
        F.count_if(p < 40).alias("low_opportunity"))
    at_risk = F.col("high_opportunity") + F.col("medium_opportunity")
    return row.select("high_opportunity", "medium_opportunity", "low_opportunity",
                      at_risk.alias("total_at_risk"),
                      percent(at_risk, F.col("n")).alias("opportunity_rate"))


def charge_threshold(df):
    """75th percentile of the monthly charge, None without charges."""
    charge = role(df.columns, "monthly_charges")
    if charge is None:
        return None
    return exact_quantiles(df.select(number(df, charge).alias("x")), ["x"], [0.75])["x"][0]


def customer_value_tiers(df, factor=None):
    """Customer rows with monthly and total value, status, probability and value tier."""
    factor = probability_factor(df) if factor is None else factor
    threshold = charge_threshold(df)
    monthly = number(df, role(df.columns, "monthly_charges"))
    tier = (F.lit("Unknown") if threshold is None else
            F.when(monthly >= threshold, "High Value").otherwise("Standard Value"))
    total = number(df, role(df.columns, "total_charges"))
    return df.withColumns({
        "monthly_value": monthly, "total_value": total,
        "churn_status": status(role(df.columns, "prediction")),
        "churn_probability": probability(df, factor), "customer_value_tier": tier})


def advanced_kpis(df, factor=None):
    """Ten measures in one pass; the only fitted value is the charge threshold."""
    threshold = charge_threshold(df)
    factor = probability_factor(df) if factor is None else factor
    charge = number(df, role(df.columns, "monthly_charges"))
    p = probability(df, factor)
    risk = role(df.columns, "risk_level")
    high_value = F.lit(False) if threshold is None else (charge >= threshold) & (p >= 70)
    row = df.agg(
        F.count("*").alias("total_customers"),
        F.count_if(status(role(df.columns, "prediction")) == "Churn").alias("predicted_churn"),
        F.avg(p).alias("p"), F.count_if(is_high_risk(risk) if risk else p >= 70).alias("high_risk_customers"),
        F.avg(number(df, role(df.columns, "tenure"))).alias("t"), F.avg(charge).alias("c"),
        F.count_if(high_value).alias("high_value_at_risk"),
        *[e.alias(k) for k, e in _risk_measures(df).items() if k == "__sum"])

    def mean(x):
        return F.round(F.coalesce(F.col(x), F.lit(0.0)), 2)
    return row.select(
        "total_customers", "predicted_churn",
        percent(F.col("predicted_churn"), F.col("total_customers")).alias("churn_rate"),
        mean("p").alias("average_probability"), "high_risk_customers",
        mean("t").alias("average_tenure"), mean("c").alias("average_monthly_charge"),
        F.round("__sum", 2).alias("monthly_revenue_at_risk"),
        F.round(F.col("__sum") * 12, 2).alias("annual_revenue_at_risk"), "high_value_at_risk")


# fixed values: display names of the KPI rows
KPI_NAMES = {
    "total_customers": "Total Customers", "predicted_churn": "Predicted Churn",
    "churn_rate": "Churn Rate (%)", "average_probability": "Average Churn Probability (%)",
    "high_risk_customers": "High/Critical Risk Customers",
    "average_tenure": "Average Tenure (Months)", "average_monthly_charge": "Average Monthly Charge",
    "monthly_revenue_at_risk": "Monthly Revenue at Risk",
    "annual_revenue_at_risk": "Annual Revenue at Risk",
    "high_value_at_risk": "High-Value Customers at Risk",
}


def analytics_summary(df, factor=None):
    """The KPIs as (seq, metric, value) rows."""
    return advanced_kpis(df, factor).select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("seq"), F.lit(name).alias("metric"),
                 F.col(k).cast("double").alias("value")) for i, (k, name) in enumerate(KPI_NAMES.items())])))


def value_counts(df, name):
    """Customers per value of a result column, most first."""
    c = role(df.columns, name) or name
    return df.groupBy(F.coalesce(col(c).cast("string"), F.lit("Unknown")).alias("category")).agg(
        F.count("*").alias("customers")).orderBy(F.desc("customers"), "category")


def probability_histogram(df, factor=None, bins=20):
    """Customers per probability range of equal width; 100 belongs to the last range."""
    factor = probability_factor(df) if factor is None else factor
    width = 100.0 / bins
    b = F.least(F.floor(F.col("p") / width), F.lit(bins - 1)).cast("int")
    return (df.select(probability(df, factor).alias("p")).where(F.col("p").isNotNull())
            .groupBy(b.alias("bin")).agg(F.count("*").alias("customers"))
            .select("bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"),
                    "customers").orderBy("bin"))


def exposure(df):
    """Total and at-risk monthly charges: by prediction, else by risk level."""
    charge = number(df, role(df.columns, "monthly_charges"))
    predicted, risk = role(df.columns, "predicted"), role(df.columns, "risk_level")
    hit = (status(predicted) == "Churn") if predicted else is_high_risk(risk) if risk else F.lit(False)
    return df.agg(money_sum(charge).alias("t"), money_sum(F.when(hit, charge)).alias("r")).select(
        F.round("t", 2).alias("total_monthly_charges"), F.round("r", 2).alias("monthly_revenue_at_risk"),
        percent(F.col("r"), F.col("t")).alias("exposure_percentage"))


def executive_insights(df, factor=None):
    """Up to ten sentences from one aggregate row."""
    words = fixed.EXECUTIVE_INSIGHTS
    factor = probability_factor(df) if factor is None else factor
    names = {r: role(df.columns, r) for r in ("contract", "risk_level", "tenure", "monthly_charges")}
    rows = _facts(
        df, factor,
        (is_high_risk(names["risk_level"]) if names["risk_level"] else F.lit(False)).alias("__risk"),
        number(df, names["tenure"]).alias("__t"), number(df, names["monthly_charges"]).alias("__c"),
        (category(names["contract"]) if names["contract"] else F.lit(None).cast("string")).alias("__k"))
    # Per contract first, then over the contracts: one scan for all sentences.
    groups = rows.groupBy("__k").agg(
        F.count("*").alias("n"), F.sum("__churn").alias("churn"),
        F.sum("__p").alias("ps"), F.count("__p").alias("pn"), F.count_if(F.col("__p") >= 70).alias("high"),
        F.count_if("__risk").alias("risk"), F.sum("__t").alias("ts"), F.count("__t").alias("tn"),
        F.sum("__c").alias("cs"), F.count("__c").alias("cn"))
    rate = F.col("churn") / F.col("n") * 100.0
    row = groups.agg(
        *[F.sum(c).alias(c) for c in ("n", "churn", "ps", "pn", "high", "risk", "ts", "tn", "cs", "cn")],
        F.min(F.when(F.col("__k").isNotNull(),
                     F.struct((-rate).alias("r"), F.col("__k").alias("k")))).alias("top"))
    c = F.col
    return sentences(row, [
        (c("pn") > 0, F.format_string(words["mean"], c("ps") / c("pn"), c("n"))),
        (c("high") > 0, F.format_string(words["high"], c("high"))),
        (c("churn") > 0, F.format_string(words["rate"], c("churn") / c("n") * 100.0)),
        (c("risk") > 0, F.format_string(words["risk"], c("risk"))),
        (c("top").isNotNull(), F.format_string(words["contract"], c("top")["k"], -c("top")["r"])),
        (c("tn") > 0, F.format_string(words["tenure"], c("ts") / c("tn"))),
        (c("cn") > 0, F.format_string(words["charge"], c("cs") / c("cn")))])


def metrics_long(df, metrics=tuple(fixed.METRIC_ORDER_DASHBOARD), model="model"):
    """(model, metric, score in percent) from a wide model table."""
    names = [m for m in metrics if m in df.columns]
    return df.select(col(model), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), (number(df, m) * 100.0).alias("score")) for m in names])))


def one_hot(df, columns, levels):
    """0/1 columns `<column>_<level>` for the given levels of each column."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[col(c) for c in rest], *[
        F.coalesce((col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns for v in levels[c]])


def one_hot_long(df, columns, key):
    """(key, feature) with feature `<column>_<level>`: one row where the wide form has a 1. For any
    number of levels."""
    return (long_form(df, columns, [key]).where(F.col("value").isNotNull())
            .select(col(key), F.concat_ws("_", "feature", "value").alias("feature")))


def distinct_levels(df, columns, most=10_000):
    """{column: sorted distinct text}. The wide form has a column per level; beyond `most` levels it is
    refused, and `one_hot_long` or `encoding.Encoding` take any number."""
    rows = (long_form(df, columns).where(F.col("value").isNotNull()).distinct().limit(most + 1).collect()
            if columns else [])
    if len(rows) > most:
        raise ValueError(f"more than {most} levels; use one_hot_long or encoding.Encoding")
    return {c: sorted(r["value"] for r in rows if r["feature"] == c) for c in columns}
