"""Classification metrics over (label, prediction, score) rows, for one or many models."""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import col, number
from ebbtide.functions.names import find_column
from ebbtide.operators.rank import average_ranks


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df, by=(), label="label", prediction="prediction"):
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negative"),
        F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"),
        F.count_if((y == 1) & (p == 1)).alias("true_positive"))


def classification_metrics(df, by=(), label="label", prediction="prediction"):
    """Accuracy, precision, recall, F1 (0 where undefined) and the confusion counts in one pass."""
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    return confusion(df, by, label, prediction).withColumns({
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1_score": _ratio(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df, model=None, label="label", score="score", rows_per_bucket=1_000_000):
    """(model, roc_auc) by the rank-sum formula: exact with tied scores, from counts per score.
    0 where only one class is present."""
    name = F.lit("all") if model is None else col(model)
    rows = df.select(name.alias("feature"), F.col(score).cast("double").alias("value"),
                     F.col(label).cast("int").alias("y")).where("value IS NOT NULL AND y IS NOT NULL")
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    ranked = average_ranks(counts, rows_per_bucket)
    # As doubles: products of counts pass the range of BIGINT.
    p, n = F.sum("positives").cast("double"), (F.sum("n") - F.sum("positives")).cast("double")
    u = F.sum(F.col("average_rank") * F.col("positives")) - p * (p + 1) / 2
    return ranked.groupBy(F.col("feature").alias("model")).agg(_ratio(u, p * n).alias("roc_auc"))


def normalize_results(df):
    """Model table with standard column names and numeric metrics."""
    for name, aliases in fixed.METRIC_ALIASES.items():
        found = find_column(df.columns, aliases)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    metrics = [m for m in fixed.METRIC_ALIASES if m != "model" and m in df.columns]
    return df.withColumns({m: number(df, m) for m in metrics}) if metrics else df


def select_best(df, order=tuple(fixed.METRIC_ORDER_TRAINING), status="status"):
    """The best successful model: the metrics in the given order, all descending."""
    if status in df.columns:
        df = df.where(col(status) == "Success")
    return df.orderBy(*[F.desc_nulls_last(m) for m in order if m in df.columns], "model").limit(1)


def best_by_first_usable(df, order=tuple(fixed.METRIC_ORDER_DASHBOARD)):
    """The best model by the first metric of the order that has any value."""
    df = normalize_results(df)
    present = [m for m in order if m in df.columns]
    counts = df.agg(*[F.count(m).alias(m) for m in present]).first() if present else {}
    usable = next((m for m in present if counts[m]), None)
    return df.orderBy(F.desc_nulls_last(usable), "model").limit(1) if usable else df.limit(1)
