"""Training: fit the candidates, compare them, keep the best.

Training rows are written once to the shared folder, so the many passes of model fitting read
a compact table and survive the loss of executors.
"""

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.functions.columns import category_columns, numeric_columns
from ebbtide.operators import features as X
from ebbtide.operators.forest import TooManyFeatures
from ebbtide.operators.metrics import classification_metrics, roc_auc, select_best
from ebbtide.operators.models import (
    CANDIDATES, TrainedModel, churn_probability, logistic_regression, random_forest)
from ebbtide.operators.roles import detect_customer_id
from ebbtide.session import materialize

METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
COUNTS = ("true_negative", "false_positive", "false_negative", "true_positive")
RESULT_SCHEMA = ("model string, " + ", ".join(f"{m} double" for m in METRICS)
                 + ", cv_f1_mean double, cv_f1_std double, "
                 + ", ".join(f"{c} long" for c in COUNTS) + ", status string")


ROWS_PER_PARTITION = 50_000
PARALLEL_FITS = 8


def prepared(train, metadata):
    """(fitted preprocessing, training matrix with weights written to the shared folder, its rows).
    Small matrices get few partitions, as linear models run many short jobs over them."""
    sizes = X.class_sizes(train)
    n = sum(sizes.values())
    prep = X.fit_preprocessor(train, metadata)
    row_id = F.xxhash64(X.KEY) if X.KEY in train.columns else F.xxhash64(*train.columns)
    train = X.with_class_weight(train, sizes).withColumn(X.ROW_ID, row_id)
    matrix = prep.transform(train).select("features", X.LABEL, "__weight", X.ROW_ID)
    return prep, materialize(matrix.coalesce(max(1, -(-n // ROWS_PER_PARTITION))), "matrix"), n


def at_once(fn, items):
    """fn of every item, a few at the same time: each fit is a chain of short jobs that leaves most
    of the cluster idle. Results keep their order."""
    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(fn, list(items), chunksize=1)


def score_rows(fitted, rows):
    out = fitted.transform(rows)
    return out.select(F.col(X.LABEL).alias("label"), F.col("__prediction").cast("int").alias("prediction"),
                      churn_probability(out).alias("score"))


def evaluate(scored):
    """Metrics of one model as a dict. The narrow score rows are written once, so the model runs
    over the data a single time."""
    scored = materialize(scored, "scores")
    row = classification_metrics(scored).first().asDict()
    auc = roc_auc(scored).first()
    return {**row, "roc_auc": auc["roc_auc"] if auc else 0.0}


def fold_count(train):
    sizes = X.class_sizes(train)
    folds = min(5, min(sizes.values(), default=0))
    return folds if folds >= 2 and len(sizes) == 2 else 0


def cross_validate(train, metadata, candidates, key=(X.KEY,)):
    """{name: (mean F1, population std)} over stratified folds. Preprocessing is fitted inside
    each fold, once for all candidates."""
    folds = fold_count(train)
    if not folds:
        return {name: (0.0, 0.0) for name in candidates}
    rows = X.with_folds(train, list(key), folds)
    prepared_folds = []
    for i in range(folds):
        prep, matrix, n = prepared(rows.where(F.col("fold") != i), metadata)
        held = prep.transform(rows.where(F.col("fold") == i)).select("features", X.LABEL)
        prepared_folds.append((matrix, n, materialize(held, "held-out")))

    def f1_score(task):
        make, (matrix, n, held) = task
        return classification_metrics(score_rows(make(n).fit(matrix), held)).first()["f1_score"]
    # The slow candidates first, so that none is left running alone at the end.
    tasks = [(name, fold) for name in reversed(list(candidates)) for fold in prepared_folds]
    scores = {name: [] for name in candidates}
    for (name, _), f1 in zip(tasks, at_once(f1_score, [(candidates[name], fold) for name, fold in tasks])):
        scores[name].append(f1)
    out = {}
    for name, f1 in scores.items():
        mean = sum(f1) / len(f1)
        out[name] = (mean, math.sqrt(sum((x - mean) ** 2 for x in f1) / len(f1)))
    return out


def train_models(train, test, metadata, candidates=None, cross_validation=True):
    """(results table, {name: TrainedModel}). A candidate that fails keeps its row, with the
    reason as status."""
    candidates = candidates or CANDIDATES
    spark = train.sparkSession
    train, test = materialize(train, "train"), materialize(test, "test")
    prep, matrix, n = prepared(train, metadata)
    held = materialize(prep.transform(test).select("features", X.LABEL), "held-out")
    rows, models, failed = {}, {}, {}

    def attempt(name):
        try:
            fitted = candidates[name](n).fit(matrix)
            return evaluate(score_rows(fitted, held)), fitted
        except Exception as error:  # the comparison goes on with the other candidates
            return None, f"Failed: {error}"
    for name, (row, fitted) in zip(candidates, at_once(attempt, candidates)):
        if row is None:
            failed[name] = fitted
        else:
            rows[name] = row
            models[name] = TrainedModel(PipelineModel([*prep.stages, fitted]), name, metadata, spark)
    cv = (cross_validate(train, metadata, {k: candidates[k] for k in rows}) if cross_validation
          else {k: (0.0, 0.0) for k in rows})
    table = []
    for name in candidates:
        r = rows.get(name)
        table.append((name, *[round(r[m], 4) if r else 0.0 for m in METRICS],
                      *[round(x, 4) for x in (cv[name] if r else (0.0, 0.0))],
                      *[int(r[c]) if r else 0 for c in COUNTS], "Success" if r else failed[name]))
    return spark.createDataFrame(table, RESULT_SCHEMA), models


def run_training(df, key=None, candidates=None, cross_validation=True):
    """(best TrainedModel, results table)."""
    train, test, metadata = X.prepare_training_data(df, key)
    results, models = train_models(train, test, metadata, candidates, cross_validation)
    best = select_best(results).first()
    if best is None:
        raise RuntimeError("all candidates failed")
    return models[best["model"]], results


def train_adaptive(df, target, key=None, trees=250, max_depth=None, min_rows=20):
    """Model from a table's own labels: balanced forest without a limit of depth, logistic regression
    if the forest refuses the features (the metadata say why). None when there are fewer than 20
    labelled rows or one class only."""
    rows = X.adaptive_rows(df, target)
    sizes = X.class_sizes(rows)
    if sum(sizes.values()) < min_rows or len(sizes) < 2:
        return None
    ident = detect_customer_id([c for c in df.columns if c != target])
    names = [c for c in df.columns if c not in (target, ident)]
    wide = X.high_cardinality_columns(rows, names)
    names = [c for c in names if c not in wide and c in numeric_columns(rows) + category_columns(rows)]
    if not names:
        return None
    key = key or ([ident] if ident else names)
    rows = rows.withColumn(X.KEY, F.struct(*key)).select(X.KEY, X.LABEL, *names)
    train, test = X.stratified_split(rows, [X.KEY])
    train, test = materialize(train, "train"), materialize(test, "test")
    metadata = {
        "target_column": target, "feature_columns": names, "adaptive_model": True,
        "numeric_features": [c for c in names if c in numeric_columns(rows)],
        "categorical_features": [c for c in names if c in category_columns(rows)]}
    prep, matrix, n = prepared(train, metadata)
    reason = None
    try:
        fitted, kind = random_forest(n, trees, max_depth, min_split=2).fit(matrix), "Random Forest"
    except TooManyFeatures as error:
        reason = str(error)
        fitted, kind = logistic_regression(n, max_iter=1000).fit(matrix), "Logistic Regression"
    auc = roc_auc(materialize(score_rows(fitted, prep.transform(test)), "scores")).first()
    metadata.update(model_type=kind, forest_refused=reason, training_rows=n, test_rows=test.count(),
                    roc_auc=auc["roc_auc"] if auc else None)
    return TrainedModel(PipelineModel([*prep.stages, fitted]), fixed.MODE_ADAPTIVE, metadata, df.sparkSession)
