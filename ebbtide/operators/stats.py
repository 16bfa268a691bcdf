"""Descriptive statistics of a customer table."""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (
    band, category_columns, col, label, long_form, missing, number, numeric_columns, percent, value)
from ebbtide.operators.quality import basic_profile
from ebbtide.operators.rank import exact_quantiles
from ebbtide.operators.roles import detect_columns
from ebbtide.session import materialize

TILE = 20


def _labelled(df, *names):
    """The named columns plus the churn label, without unreadable labels; None if there is no
    churn column. Only these columns are scanned."""
    churn = detect_columns(df.columns)["churn"]
    if churn is None or any(n is None for n in names):
        return None
    return df.select(*[col(n) for n in names], label(df, churn).alias("__y")).where(
        F.col("__y").isNotNull())


def churn_analysis(df):
    rows = _labelled(df)
    total = F.col("churned_customers") + F.col("retained_customers")
    return rows.agg(F.count_if(F.col("__y") == 1).alias("churned_customers"),
                    F.count_if(F.col("__y") == 0).alias("retained_customers")).select(
        total.alias("total_customers"), "churned_customers", "retained_customers",
        percent(F.col("churned_customers"), total).alias("churn_rate"),
        percent(F.col("retained_customers"), total).alias("retention_rate"))


def churn_distribution(df):
    return churn_analysis(df).select(F.inline(F.array(
        F.struct(F.lit("Churned").alias("status"), F.col("churned_customers").alias("customers"),
                 F.col("churn_rate").alias("percentage")),
        F.struct(F.lit("Retained").alias("status"), F.col("retained_customers").alias("customers"),
                 F.col("retention_rate").alias("percentage")))))


def missing_values(df):
    """Missing cells per column, most first: one aggregate row, then one row per column."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(missing(df, c)).alias(f"m{i}")
                                           for i, c in enumerate(df.columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_values"),
                 F.when(F.col("n") > 0, F.col(f"m{i}") / F.col("n") * 100.0).otherwise(0.0)
                 .alias("missing_percentage")) for i, c in enumerate(df.columns)]))
    ).orderBy(F.desc("missing_values"), "column_name")


def _numbers(df, columns=None):
    columns = columns or numeric_columns(df)
    return columns, df.select(*[value(df, c).cast("double").alias(c) for c in columns])


def numeric_summary(df, columns=None):
    """count, mean, std, min, quartiles, max per numeric column."""
    columns, rows = _numbers(df, columns)
    quartiles = exact_quantiles(rows, columns, [0.25, 0.5, 0.75])
    row = rows.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (
        ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"),
                 F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                 F.col(f"min{i}").alias("min"),
                 *[F.lit(q).cast("double").alias(k) for k, q in zip(("q25", "q50", "q75"), quartiles[c])],
                 F.col(f"max{i}").alias("max")) for i, c in enumerate(columns)])))


def categorical_summary(df, columns=None):
    """Distinct values, the most common one (smallest on a tie) and its count per column. Values
    are counted before the per-column step, which only keeps a running best."""
    columns = columns or category_columns(df)
    counts = (long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
              .withColumn("seen", F.col("value").isNotNull()))
    best = F.min(F.when(F.col("seen"), F.struct((-F.col("n")).alias("n"), "value")))
    return counts.groupBy("feature").agg(
        F.count_if("seen").alias("unique_values"),
        F.coalesce(best["value"], F.lit("N/A")).alias("most_common"),
        F.coalesce(-best["n"], F.lit(0)).alias("most_common_count"))


def churn_by_column(df, column, min_group_size=1):
    """Churn and retention rate per value of a column, highest rate first."""
    rows = _labelled(df, column)
    if rows is None or column not in df.columns:
        return None
    grouped = rows.groupBy(F.coalesce(col(column).cast("string"), F.lit("Unknown")).alias("category")).agg(
        F.count("*").alias("customers"), F.sum("__y").alias("churned"))
    rate = F.col("churned") / F.col("customers") * 100.0
    return grouped.where(F.col("customers") >= min_group_size).select(
        "category", "customers", "churned", F.round(rate, 2).alias("churn_rate"),
        F.round(100.0 - rate, 2).alias("retention_rate")).orderBy(F.desc("churn_rate"), "category")


def contract_churn(df):
    return churn_by_column(df, detect_columns(df.columns)["contract"])


def payment_churn(df):
    return churn_by_column(df, detect_columns(df.columns)["payment_method"])


def all_bands(grouped, bands, keep):
    """One row per band in band order; a band without rows gets zeros. The list is fixed."""
    listed = grouped.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(b) for b in bands])).alias("band_order", "band"))
    return (listed.join(F.broadcast(grouped), "band", "left")
            .select("band_order", "band", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in keep]))


def tenure_churn(df):
    """Churn by tenure band; the longest tenure decides which bands are used."""
    roles = detect_columns(df.columns)
    rows = _labelled(df, roles["tenure"])
    if rows is None:
        return None
    rows = rows.select(number(rows, roles["tenure"]).alias("t"), F.col("__y")).where(F.col("t").isNotNull())
    longest = rows.agg(F.max("t")).first()[0]
    if longest is None:
        return None
    bands = (fixed.TENURE_BANDS_SHORT if longest <= 12 else
             fixed.TENURE_BANDS_MIDDLE if longest <= 36 else fixed.TENURE_BANDS_LONG)
    grouped = rows.groupBy(band(F.col("t"), bands).alias("band")).agg(
        F.count("*").alias("customers"), F.sum("__y").alias("churned"))
    return all_bands(grouped, [b for _, b in bands], ["customers", "churned"]).select(
        "band_order", F.col("band").alias("tenure_group"), "customers", "churned",
        percent(F.col("churned"), F.col("customers")).alias("churn_rate")).orderBy("band_order")


def correlations(df, columns=None):
    """(feature_a, feature_b, correlation) over all ordered pairs, from complete pairs only. Each pair
    is computed once, in tiles of columns; a table wider than one tile is written once, and every
    tile then reads its own columns only."""
    columns, rows = _numbers(df, columns)
    parts = [columns[k:k + TILE] for k in range(0, len(columns), TILE)]
    if len(parts) > 1:
        rows = materialize(rows, "numbers")
    out = None
    for s, left in enumerate(parts):
        for t, right in enumerate(parts[s:], s):
            pairs = [(a, b) for i, a in enumerate(left) for b in (left[i:] if s == t else right)]
            row = rows.agg(*[F.corr(col(a), col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
            cells = [F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"),
                              F.col(f"c{i}").alias("correlation"))
                     for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
            piece = row.select(F.inline(F.array(*cells)))
            out = piece if out is None else out.unionByName(piece)
    return out


def correlation_matrix(df, columns=None):
    columns = columns or numeric_columns(df)
    return (correlations(df, columns).groupBy("feature_a")
            .pivot("feature_b", columns).agg(F.first("correlation")))


def outliers(df, columns=None):
    """Values beyond 1.5 quartile ranges per numeric column."""
    columns, rows = _numbers(df, columns)
    edges = {c: q for c, q in exact_quantiles(rows, columns, [0.25, 0.75]).items() if q[0] is not None}
    exprs = []
    for i, (c, (q1, q3)) in enumerate(edges.items()):
        reach = 1.5 * (q3 - q1)
        exprs += [F.count(col(c)).alias(f"n{i}"),
                  F.count_if((col(c) < q1 - reach) | (col(c) > q3 + reach)).alias(f"o{i}")]
    return rows.agg(*exprs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"o{i}").alias("outliers"),
                 percent(F.col(f"o{i}"), F.col(f"n{i}")).alias("outlier_percentage"))
        for i, c in enumerate(edges)])))


def sentences(row, items):
    """(seq, insight) from a one-row table and (condition, text) pairs; false ones are left out."""
    texts = F.array_compact(F.array(*[F.when(cond, text) for cond, text in items]))
    return row.select(F.posexplode(texts).alias("pos", "insight")).select(
        (F.col("pos") + 1).alias("seq"), "insight")


def eda_insights(df):
    """Sentences on overall churn, the worst contract and the worst tenure band."""
    words = fixed.EDA_INSIGHTS
    if detect_columns(df.columns)["churn"] is None:
        return df.sparkSession.range(1).select(F.lit(1).alias("seq"), F.lit(words["none"]).alias("insight"))
    row = churn_analysis(df)
    rate = F.col("churn_rate")
    items = [
        (F.col("total_customers") == 0, F.lit(words["none"])),
        (rate >= 30, F.format_string(words["high"], rate)),
        ((rate >= 20) & (rate < 30), F.format_string(words["middle"], rate)),
        ((F.col("total_customers") > 0) & (rate < 20), F.format_string(words["low"], rate))]
    for part, key, name in ((contract_churn(df), "contract", "category"),
                            (tenure_churn(df), "tenure", "tenure_group")):
        if part is not None:
            order = "category" if key == "contract" else "band_order"
            top = part.agg(F.max_by(F.struct(F.col(name).alias("name"), F.col("churn_rate").alias("rate")),
                                    F.struct("churn_rate", _descending(part, order))).alias("t"))
            row = row.withColumn(key, top.scalar())
            got = F.col(key)
            args = (got["rate"], got["name"]) if key == "contract" else (got["name"], got["rate"])
            items.append((got.isNotNull() & (F.col("total_customers") > 0),
                          F.format_string(words[key], *args)))
    return sentences(row, items)


def _descending(df, order):
    """Tie-break for max_by that prefers the first band or, for text, any fixed value."""
    return -F.col(order) if order == "band_order" else F.col(order)


def run_eda(df):
    """All analyses as lazy tables, by name."""
    return {
        "profile": basic_profile(df), "detected_columns": detect_columns(df.columns),
        "churn": churn_analysis(df), "distribution": churn_distribution(df),
        "missing_values": missing_values(df), "numeric_summary": numeric_summary(df),
        "categorical_summary": categorical_summary(df), "contract_analysis": contract_churn(df),
        "payment_analysis": payment_churn(df), "tenure_analysis": tenure_churn(df),
        "correlation": correlation_matrix(df), "outliers": outliers(df), "insights": eda_insights(df),
    }
