"""Data-quality facts. Rows are grouped by their whole content once; every count follows from
the distinct rows and how often each occurs, so one scan and one shuffle serve all measures."""

from functools import reduce

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import (category_columns, col, long_form, missing, numeric_columns,
                                       value)
from ebbtide.operators.roles import detect_columns


def _texts(items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _roles_map(columns):
    return F.create_map(*[x for r, c in detect_columns(columns).items()
                          for x in (F.lit(r), F.lit(c).cast("string"))])


def row_facts(df, exact=True):
    """One row: counts of rows, distinct rows, missing cells, empty and complete rows.

    Exact comparison shuffles whole rows. With `exact=False` rows are told apart by two
    independent 64-bit hashes, so 20 bytes per row travel instead; two different rows then count
    as one with a chance of about rows^2 / 2^129.
    """
    names = df.columns
    gaps = reduce(lambda a, b: a + b, [missing(df, c).cast("long") for c in names])
    keys = [col(c) for c in names] if exact else [
        F.xxhash64(F.lit(seed), *[value(df, c) for c in names]).alias(f"__h{seed}") for seed in (1, 2)]
    whole = df.withColumn("__gaps", gaps).groupBy(*keys, "__gaps").agg(F.count("*").alias("__n"))
    n, g = F.col("__n"), F.col("__gaps")

    def total(x):
        return F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return whole.agg(
        total(n).alias("rows"),
        F.lit(len(names)).cast("long").alias("columns"),
        total(n * g).alias("missing_cells"),
        (total(n) - F.count("*")).alias("duplicate_rows"),
        total(F.when(g == len(names), n)).alias("empty_rows"),
        total(F.when(g == 0, n)).alias("complete_rows"))


def _share(part, whole):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100.0).otherwise(0.0)


def quality_check(df, exact=True):
    cells = F.col("rows") * F.col("columns")
    return row_facts(df, exact).select(
        (F.col("rows") > 0).alias("valid"), "rows", "columns", "missing_cells",
        F.round(F.when(cells > 0, F.col("missing_cells") / cells * 100.0).otherwise(0.0), 2)
        .alias("missing_percentage"),
        "duplicate_rows", "empty_rows")


def basic_profile(df):
    return quality_check(df).select(
        "rows", "columns", "missing_cells", "missing_percentage", "duplicate_rows",
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(category_columns(df))).cast("long").alias("categorical_columns"))


def dataset_summary(df):
    return quality_check(df).select(
        "rows", "columns", "missing_cells", "missing_percentage", "duplicate_rows",
        _texts(numeric_columns(df)).alias("numeric_columns"),
        _texts(category_columns(df)).alias("categorical_columns"),
        _roles_map(df.columns).alias("detected_columns"))


def churn_readiness(df):
    """Quality check plus whether churn analysis is possible, with warnings."""
    roles = detect_columns(df.columns)
    features = [r for r in ("tenure", "monthly_charges", "total_charges", "contract",
                            "payment_method") if roles[r]]
    words = fixed.READINESS
    warnings = F.array_compact(F.array(
        F.lit(None if roles["customer_id"] else words["no_id"]).cast("string"),
        F.lit(None if features else words["no_feature"]).cast("string"),
        F.when(F.col("missing_percentage") > 30, words["missing"]),
        F.when(F.col("duplicate_rows") > 0,
               F.format_string(words["duplicates"], F.col("duplicate_rows")))))
    return quality_check(df).select(
        "*",
        (F.col("valid") & F.lit(bool(roles["churn"] and features))).alias("churn_ready"),
        _roles_map(df.columns).alias("detected_columns"),
        _texts([] if roles["churn"] else [words["target"]]).alias("missing_required"),
        warnings.alias("warnings"),
        F.lit(len(features)).cast("long").alias("feature_count"))


def data_quality(df, exact=True):
    """Weighted score of missing cells (0.4), duplicates (0.2) and complete rows (0.4)."""
    f = row_facts(df, exact).select(
        "*", (F.col("rows") * F.col("columns")).alias("cells")).select(
        "*", _share("missing_cells", "cells").alias("m"), _share("duplicate_rows", "rows").alias("d"),
        _share("complete_rows", "rows").alias("c"))
    score = (F.greatest(F.lit(0.0), 100.0 - F.col("m") * 2) * 0.40
             + F.greatest(F.lit(0.0), 100.0 - F.col("d") * 2) * 0.20
             + F.col("c") * 0.40)
    numeric = len(numeric_columns(df))
    return f.select(
        F.when(F.col("rows") > 0, F.round(F.least(F.lit(100.0), score), 2)).otherwise(0.0)
        .alias("quality_score"),
        "missing_cells", "duplicate_rows", "rows", "columns",
        F.round("m", 2).alias("missing_percentage"),
        F.round("d", 2).alias("duplicate_percentage"),
        "complete_rows", F.round("c", 2).alias("complete_row_percentage"),
        F.lit(numeric).cast("long").alias("numeric_columns"),
        F.lit(len(df.columns) - numeric).cast("long").alias("categorical_columns"))


def column_profile(df, exact=True):
    """Type, missing and distinct values per column. `exact=False` trades the shuffle of all
    distinct values for a sketch, for very wide or very long tables."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields
                           for x in (f.name, f.dataType.simpleString())])
    cells = long_form(df, df.columns)
    if exact:
        per_value = cells.groupBy("feature", "value").agg(F.count("*").alias("n"))
        per_column = per_value.groupBy("feature").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("value").alias("unique_values"))
    else:
        per_column = cells.groupBy("feature").agg(
            F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"),
            F.approx_count_distinct("value").alias("unique_values"))
    return per_column.select(
        F.col("feature").alias("column_name"), types[F.col("feature")].alias("data_type"),
        F.col("missing").cast("long").alias("missing"),
        F.round(F.col("missing") / F.col("rows") * 100.0, 2).alias("missing_percentage"),
        "unique_values",
        F.round(F.col("unique_values") / F.col("rows") * 100.0, 2).alias("unique_percentage"))
