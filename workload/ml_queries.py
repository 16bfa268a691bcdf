"""Features, training and model comparison."""

from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.operators import boosting, breakdown, features, forest, metrics, models
from ebbtide.operators.encoding import Encoding
from ebbtide.plans import scoring, training
from ebbtide.session import new_path
from ebbtide.sources import files
from workload.registry import query
from workload.sql_parts import label, signal, stats
from workload.views import customer_360, r2, stored, with_views


def training_customers(spark, sf):
    """Customers with a label. Recency and the probability made from it define the label, so
    they are no features."""
    return stored(customer_360, spark, sf).drop("recency_months", "churn_probability", "customer_key")


K1 = ["customer_id", "gender", "plan_segment", "contract", "tenure", "usage_events", "constant", "empty", "row_number", "account_id_old"]


@query("k1_feature_selection", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {('count(*) > 0' if c == 'row_number' else f'''count(DISTINCT coalesce(CAST({c} AS VARCHAR), '~')) <= 1''')} AS useless, "
    f"{'true' if c in ('customer_id', 'account_id_old') else 'false'} AS identifier, "
    f"{f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.95' if c in ('customer_id', 'gender', 'plan_segment', 'contract', 'constant', 'account_id_old') else 'false'} AS nearly_unique FROM k"
    for c in K1), extra="""
k AS (SELECT *, 'x' AS constant, CAST(NULL AS VARCHAR) AS empty, customer_key AS row_number, gender AS account_id_old FROM customer_360)"""))
def k1_feature_selection(spark, sf):
    d = stored(customer_360, spark, sf).withColumns({
        "constant": F.lit("x"), "empty": F.lit(None).cast("string"), "row_number": F.col("customer_key"),
        "account_id_old": F.col("gender")}).select(*K1, "churn")
    useless = features.useless_columns(d, "churn")
    idents = features.identifier_columns(d.columns, "churn")
    wide = features.high_cardinality_columns(d, K1)
    return d.groupBy().count().select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(c in useless).alias("useless"),
                 F.lit(c in idents).alias("identifier"), F.lit(c in wide).alias("nearly_unique")) for c in K1])))


@query("k3_stratified_split", with_views("""
SELECT label, 'test' AS side, CAST(round(0.2 * n) AS BIGINT) AS customers, true AS whole FROM n
UNION ALL SELECT label, 'train', n - CAST(round(0.2 * n) AS BIGINT), true FROM n""",
    extra=f"n AS (SELECT {label('churn')} AS label, count(*) AS n FROM customer_360 WHERE churn IS NOT NULL GROUP BY 1)"))
def k3_stratified_split(spark, sf):
    train, test, _ = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy(F.col(features.LABEL).alias("label"), "side").agg(
        F.count("*").alias("customers"),
        (F.countDistinct(features.KEY) == F.count("*")).alias("whole"))


@query("k3_folds", with_views("""
SELECT label, CAST(f AS INTEGER) AS fold, CAST(round((f + 1) / CAST(5 AS DOUBLE) * n) - round(f / CAST(5 AS DOUBLE) * n) AS BIGINT) AS customers
FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f)""",
    extra=f"n AS (SELECT {label('churn')} AS label, count(*) AS n FROM customer_360 WHERE churn IS NOT NULL GROUP BY 1)"))
def k3_folds(spark, sf):
    rows, _ = features.labelled_rows(training_customers(spark, sf))
    return features.with_folds(rows, ["customer_id"], 5).groupBy(
        F.col(features.LABEL).alias("label"), "fold").agg(F.count("*").alias("customers"))


NUMBERS = ["senior_citizen", "tenure", "usage_events", "support_tickets", "total_charges", "monthly_charges"]
LEVELS = {"gender": ["Female", "Male"], "plan_segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
          "internet_service": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
          "contract": ["Month-to-month", "One year", "Two year"],
          "payment_method": ["Bank transfer", "Credit card", "Electronic check", "Mailed check"]}
LABELLED = f"y AS (SELECT *, {label('churn')} AS yy FROM customer_360 WHERE churn IS NOT NULL)"
FILLED = LABELLED + ", f AS (SELECT customer_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM y)) AS {c}" for c in NUMBERS) + ", " + ", ".join(LEVELS) + " FROM y)"


@query("k2_processed_dataset", with_views(
    "SELECT " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM y)) AS {c}" for c in NUMBERS)
    + ", yy AS \"Churn\", " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs)
    + " FROM y", extra=LABELLED))
def k2_processed_dataset(spark, sf):
    return features.processed_dataset(training_customers(spark, sf))


@query("k4_category_codes", with_views("SELECT customer_id, feature, id FROM cells JOIN levels USING (feature, value)", extra="""
cells AS (SELECT customer_id, 'contract' AS feature, contract AS value FROM customer_360
  UNION ALL SELECT customer_id, 'customer_key', CAST(customer_key AS VARCHAR) FROM customer_360),
levels AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS id
  FROM (SELECT DISTINCT feature, value FROM cells WHERE value IS NOT NULL))"""))
def k4_category_codes(spark, sf):
    d = stored(customer_360, spark, sf)
    return Encoding.fit(d, ["contract", "customer_key"]).ids(d, "customer_id")


@query("k4_preprocessing", with_views("SELECT customer_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_samp({c}) FROM f), 6) AS {c}" for c in NUMBERS) + ", " + ", ".join(
    f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs) + " FROM f", extra=FILLED))
def k4_preprocessing(spark, sf):
    """Features of all labelled customers, preprocessed by what all of them taught."""
    from pyspark.ml.functions import vector_to_array
    train, test, meta = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    rows = train.unionByName(test)
    prep = features.fit_preprocessor(rows, meta)
    out = prep.transform(rows).withColumn("x", vector_to_array("features"))
    return out.select(F.col(features.KEY)["customer_id"].alias("customer_id"), *[
        (F.round(F.col("x")[i], 6) if n in NUMBERS else F.col("x")[i]).alias(n)
        for i, n in enumerate(features.feature_names(prep, meta))])


TEST_SIDE = """
n AS (SELECT yy, count(*) AS n FROM y GROUP BY yy),
t AS (SELECT CAST(sum(round(0.2 * n)) AS BIGINT) AS test_rows, CAST(sum(round(0.2 * n)) FILTER (yy = 1) AS BIGINT) AS churners,
      CAST(sum(n - round(0.2 * n)) AS BIGINT) AS training_rows, least(5, min(n)) AS folds FROM n)"""
PROPERTIES = "test_rows, churners, 'Success' AS status, true AS better_than_chance, true AS consistent"


def _checked(results):
    """What must hold for the hold-out result of any model that has learned something."""
    tn, fp, fn, tp = (F.col(c) for c in training.COUNTS)

    def close(metric, part, whole):
        return F.abs(F.col(metric) - F.coalesce(F.try_divide(part, whole), F.lit(0.0))) <= 0.00006
    return results.select(
        "model", (tn + fp + fn + tp).alias("test_rows"), (tp + fn).alias("churners"), "status",
        (F.col("roc_auc") > 0.5).alias("better_than_chance"),
        (close("accuracy", tp + tn, tn + fp + fn + tp) & close("precision", tp, tp + fp) & close("recall", tp, tp + fn)
         & close("f1_score", 2 * tp, 2 * tp + fp + fn)).alias("consistent"), "cv_f1_mean", "cv_f1_std")


def _fit_one(spark, sf, name):
    train, test, meta = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    return training.train_models(train, test, meta, {name: models.CANDIDATES[name]}, cross_validation=False)[0]


def _register_candidates():
    for key, name in (("k5_logistic_regression", "Logistic Regression"), ("k6_decision_tree", "Decision Tree"),
                      ("k7_random_forest", "Random Forest"), ("k8_extra_trees", "Extra Trees"),
                      ("k9_gradient_boosting", "Gradient Boosting"), ("k10_histogram_boosting", "HistGradient Boosting")):
        query(key, with_views(f"SELECT '{name}' AS model, {PROPERTIES} FROM t", extra=LABELLED + "," + TEST_SIDE))(
            lambda spark, sf, name=name: _checked(_fit_one(spark, sf, name)).drop("cv_f1_mean", "cv_f1_std"))


_register_candidates()


LEVEL_FEATURES = [(f"{c}_{v}", f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END") for c, vs in LEVELS.items() for v in vs]
# Every feature of every labelled customer as (place, name, value, label), and rows by feature and value.
LONG_FEATURES = FILLED + """,
fl AS (SELECT f.*, y.yy FROM f JOIN y USING (customer_id)),
v AS (%s),
n AS (SELECT count(*) AS n, sum(yy) AS ones FROM fl)""" % " UNION ALL ".join(
    f"SELECT {i} AS place, '{name}' AS name, CAST({expr} AS DOUBLE) AS x, yy FROM fl"
    for i, (name, expr) in enumerate([(c, c) for c in NUMBERS] + LEVEL_FEATURES))


def _first_split(spark, sf, make):
    """The first split of the first tree over all labelled customers: feature, and by side its
    customers, churners and leaf value."""
    from pyspark.ml.functions import vector_to_array
    train, test, meta = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    prep, matrix, _ = training.prepared(training.materialize(train.unionByName(test)), meta)
    names = features.feature_names(prep, meta)
    nodes = make(len(names)).fit(matrix).nodes
    f, cut = int(nodes.feature[0]), float(nodes.threshold[0])
    values = [float(nodes.value[k]) for k in (nodes.left[0], nodes.right[0])]
    side = F.when(vector_to_array("features")[f] <= cut, "left").otherwise("right").alias("side")
    return matrix.groupBy(F.lit(names[f]).alias("feature"), side).agg(
        F.count("*").alias("customers"), F.sum(features.LABEL).alias("churners")).withColumn(
        "value", F.round(F.when(F.col("side") == "left", values[0]).otherwise(values[1]), 7))


def _sides(best, value):
    """SQL of both sides of the split in `best` (name, n, ones: left rows and churners)."""
    return f"""
SELECT name AS feature, 'left' AS side, lrows AS customers, lones AS churners, {value('lrows', 'lones')} AS value FROM {best}
UNION ALL SELECT name, 'right', n - lrows, ones - lones, {value('(n - lrows)', '(ones - lones)')} FROM {best}"""


W1, W0 = "(n / (2.0 * ones))", "(n / (2.0 * (n - ones)))"


def _gini(rows, ones):
    a, b = f"({W0} * ({rows} - {ones}))", f"({W1} * {ones})"
    return f"(({a} * {a} + {b} * {b}) / ({a} + {b}))"


@query("k7_first_split", with_views(
    _sides("best", lambda rows, ones: f"round(CAST({W1} * {ones} / ({W1} * {ones} + {W0} * ({rows} - {ones})) AS DOUBLE), 7)"),
    extra=LONG_FEATURES + f""",
cum AS (SELECT place, name, x, sum(count(*)) OVER w AS lrows, sum(sum(yy)) OVER w AS lones FROM v GROUP BY place, name, x
        WINDOW w AS (PARTITION BY place ORDER BY x)),
best AS (SELECT name, n, ones, lrows, lones FROM cum CROSS JOIN n WHERE lrows >= 2 AND n - lrows >= 2
         ORDER BY round(CAST({_gini('lrows', 'lones')} + {_gini('(n - lrows)', '(ones - lones)')} AS DOUBLE), 6) DESC, place, x LIMIT 1)"""))
def k7_first_split(spark, sf):
    """The best of all thresholds of all features, by weighted Gini impurity."""
    return _first_split(spark, sf, lambda width: forest.Forest(1, 1, 2, bootstrap=False, features=width))


P = "(ones / CAST(n AS DOUBLE))"


def _newton(rows, ones):
    return f"({rows} * {P} - {ones})", f"({rows} * {P} * (1 - {P}))"


def _second(rows, ones):
    g, h = _newton(rows, ones)
    return f"({g} * {g} / ({h} + 1))"


@query("k10_first_split", with_views(
    _sides("best", lambda rows, ones: f"round(-0.05 * {_newton(rows, ones)[0]} / ({_newton(rows, ones)[1]} + 1), 7)"),
    extra=LONG_FEATURES + f""",
ranked AS (SELECT place, name, x, row_number() OVER (PARTITION BY place ORDER BY x) AS k FROM v),
few AS (SELECT place FROM v GROUP BY place HAVING count(DISTINCT x) <= 255),
borders AS (SELECT DISTINCT place, x FROM v WHERE place IN (SELECT place FROM few)
  UNION SELECT DISTINCT r.place, r.x FROM ranked r CROSS JOIN n JOIN (SELECT unnest(range(1, 256)) AS j) ON r.k = greatest(1, CAST(round_even(n * j / CAST(255 AS DOUBLE), 0) AS BIGINT))
        WHERE r.place NOT IN (SELECT place FROM few)),
binned AS (SELECT v.place, v.name, v.yy, b.x FROM v ASOF JOIN borders b ON v.place = b.place AND v.x <= b.x),
cum AS (SELECT place, name, x, sum(count(*)) OVER w AS lrows, sum(sum(yy)) OVER w AS lones FROM binned GROUP BY place, name, x
        WINDOW w AS (PARTITION BY place ORDER BY x)),
best AS (SELECT name, n, ones, lrows, lones FROM cum CROSS JOIN n WHERE lrows >= 10 AND n - lrows >= 10
         ORDER BY round({_second('lrows', 'lones')} + {_second('(n - lrows)', '(ones - lones)')}, 6) DESC, place, x LIMIT 1)"""))
def k10_first_split(spark, sf):
    """The first split of second-order boosting over at most 255 bins of each feature."""
    return _first_split(spark, sf, lambda width: boosting.Boosting(1, boosting.Rules(max_leaves=2)))


@query("k11_class_weights", with_views("""
SELECT label, n AS customers, (SELECT sum(n) FROM n) / CAST((SELECT count(*) FROM n) * n AS DOUBLE) AS weight FROM n""",
    extra=f"n AS (SELECT {label('churn')} AS label, count(*) AS n FROM customer_360 WHERE churn IS NOT NULL GROUP BY 1)"))
def k11_class_weights(spark, sf):
    rows, _ = features.labelled_rows(training_customers(spark, sf))
    return features.with_class_weight(rows).groupBy(F.col(features.LABEL).alias("label")).agg(
        F.count("*").alias("customers"), F.first("__weight").alias("weight"))


def rule_scores(spark, sf):
    """(model, label, prediction, score): three simple rules applied to every labelled customer,
    so that metrics can be checked without a trained model."""
    d = stored(customer_360, spark, sf).where("churn IS NOT NULL")

    def rule(name, score, hit):
        return F.struct(F.lit(name).alias("model"), hit.cast("int").alias("prediction"),
                        score.cast("double").alias("score"))
    rules = F.array(
        rule("Short Tenure", -F.col("tenure"), F.col("tenure") <= 48),
        rule("High Charge", F.col("monthly_charges"), F.col("monthly_charges") >= 30000),
        rule("Small Total", -F.col("total_charges"), F.col("total_charges") < 2500000))
    return d.select((F.col("churn") == "Yes").cast("int").alias("label"), F.inline(rules))


RULES = """
s AS (SELECT 'Short Tenure' AS model, CASE churn WHEN 'Yes' THEN 1 ELSE 0 END AS label, CAST(tenure <= 48 AS INTEGER) AS prediction, CAST(-tenure AS DOUBLE) AS score FROM customer_360 WHERE churn IS NOT NULL
  UNION ALL SELECT 'High Charge', CASE churn WHEN 'Yes' THEN 1 ELSE 0 END, CAST(monthly_charges >= 30000 AS INTEGER), monthly_charges FROM customer_360 WHERE churn IS NOT NULL
  UNION ALL SELECT 'Small Total', CASE churn WHEN 'Yes' THEN 1 ELSE 0 END, CAST(total_charges < 2500000 AS INTEGER), -total_charges FROM customer_360 WHERE churn IS NOT NULL),
c AS (SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS true_negative, count(*) FILTER (label = 0 AND prediction = 1) AS false_positive,
  count(*) FILTER (label = 1 AND prediction = 0) AS false_negative, count(*) FILTER (label = 1 AND prediction = 1) AS true_positive FROM s GROUP BY model),
m AS (SELECT *, (true_positive + true_negative) / CAST(true_positive + true_negative + false_positive + false_negative AS DOUBLE) AS accuracy,
  coalesce(true_positive / CAST(nullif(true_positive + false_positive, 0) AS DOUBLE), 0) AS precision,
  coalesce(true_positive / CAST(nullif(true_positive + false_negative, 0) AS DOUBLE), 0) AS recall,
  coalesce(2 * true_positive / CAST(nullif(2 * true_positive + false_positive + false_negative, 0) AS DOUBLE), 0) AS f1_score FROM c),
rk AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) - 1 + (count(*) OVER (PARTITION BY model, score) + 1) / CAST(2 AS DOUBLE) AS r FROM s),
auc AS (SELECT model, (sum(r) FILTER (label = 1) - p * (p + 1) / CAST(2 AS DOUBLE)) / CAST(p * n AS DOUBLE) AS roc_auc
  FROM rk JOIN (SELECT model, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY model) USING (model) GROUP BY model, p, n),
full_m AS (SELECT m.*, roc_auc FROM m JOIN auc USING (model))"""


def rule_metrics(spark, sf):
    rows = rule_scores(spark, sf)
    return metrics.classification_metrics(rows, ["model"]).join(metrics.roc_auc(rows, "model"), "model")


@query("k12_metrics", with_views("SELECT * FROM m", extra=RULES))
def k12_metrics(spark, sf):
    return metrics.classification_metrics(rule_scores(spark, sf), ["model"])


@query("k13_roc_auc", with_views(f"SELECT model, {r2('roc_auc', 10)} AS roc_auc FROM auc", extra=RULES))
def k13_roc_auc(spark, sf):
    return metrics.roc_auc(rule_scores(spark, sf), "model").withColumn("roc_auc", F.round("roc_auc", 10))


SIX = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in models.CANDIDATES) + "]) AS model)"


@query("k14_cross_validation", with_views(f"SELECT model, folds, true AS within_bounds FROM {SIX} CROSS JOIN t", extra=LABELLED + "," + TEST_SIDE))
def k14_cross_validation(spark, sf):
    """All six candidates, each with its default trees and rounds, over all folds."""
    train, _, meta = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    train = training.materialize(train)
    got = training.cross_validate(train, meta, models.CANDIDATES)
    rows = spark.createDataFrame([(n, training.fold_count(train), *got[n]) for n in got], "model string, folds long, mean double, std double")
    return rows.select("model", "folds", F.expr("mean > 0 AND mean <= 1 AND std >= 0 AND std <= 0.5").alias("within_bounds"))


@query("k15_train_models", with_views(f"SELECT model, {PROPERTIES} FROM {SIX} CROSS JOIN t", extra=LABELLED + "," + TEST_SIDE))
def k15_train_models(spark, sf):
    """The comparison of all six candidates on the hold-out rows, with default trees and rounds; their
    cross-validation is k14."""
    results = training.run_training(training_customers(spark, sf), "customer_id", cross_validation=False)[1]
    return _checked(results).drop("cv_f1_mean", "cv_f1_std")


@query("k16_select_best", with_views(
    "SELECT model, f1_score FROM full_m ORDER BY f1_score DESC, roc_auc DESC, recall DESC, accuracy DESC, model LIMIT 1", extra=RULES))
def k16_select_best(spark, sf):
    return metrics.select_best(rule_metrics(spark, sf)).select("model", "f1_score")


@query("k17_best_model_metrics", with_views(
    f"SELECT model, accuracy, f1_score, {r2('roc_auc', 10)} AS roc_auc FROM full_m ORDER BY full_m.roc_auc DESC, model LIMIT 1", extra=RULES))
def k17_best_model_metrics(spark, sf):
    d = rule_metrics(spark, sf).select(
        F.col("model").alias("Algorithm"), F.col("accuracy").cast("string").alias("Accuracy"),
        F.col("f1_score").cast("string").alias("F1"), F.col("roc_auc").alias("ROC AUC"))
    return metrics.best_by_first_usable(d).withColumn("roc_auc", F.round("roc_auc", 10))


@query("j4_metrics_long", with_views(" UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {r2(f'{m} * CAST(100 AS DOUBLE)', 8)} AS score FROM full_m" for m in
    ("roc_auc", "f1_score", "accuracy", "recall", "precision")), extra=RULES))
def j4_metrics_long(spark, sf):
    return breakdown.metrics_long(rule_metrics(spark, sf)).withColumn("score", F.round("score", 8))


@query("a3_model_results", with_views(
    f"SELECT model, {r2('accuracy', 4)} AS accuracy, {r2('f1_score', 4)} AS f1_score FROM full_m", extra=RULES))
def a3_model_results(spark, sf):
    d = rule_metrics(spark, sf).select("model", F.round("accuracy", 4).alias("accuracy"),
                                       F.round("f1_score", 4).alias("f1_score"))
    path = files.write_csv(d, new_path(spark, "model-results"))
    return metrics.normalize_results(files.model_results(spark, [new_path(spark, "missing"), path]))


@query("k18_adaptive_model", with_views(
    "SELECT customer_id, true AS within_bounds, 'Random Forest' AS model_type, training_rows, test_rows, true AS better_than_chance FROM customer_360 CROSS JOIN t",
    extra=LABELLED + "," + TEST_SIDE))
def k18_adaptive_model(spark, sf):
    model = training.train_adaptive(training_customers(spark, sf), "churn")
    facts = model.metadata
    return model.predict(training_customers(spark, sf)).select(
        "customer_id", F.expr("__probability >= 0 AND __probability <= 1 AND (__prediction = 1) = (__probability > 0.5) OR __probability = 0.5").alias("within_bounds"),
        F.lit(facts["model_type"]).alias("model_type"), F.lit(facts["training_rows"]).cast("long").alias("training_rows"),
        F.lit(facts["test_rows"]).cast("long").alias("test_rows"), F.lit(facts["roc_auc"] > 0.5).alias("better_than_chance"))


def _scoring_facts(scored):
    """What must hold for scored customers whatever the model."""
    p = F.col("churn_probability")
    level = (F.when(p >= 75, "Critical").when(p >= 50, "High").when(p >= 25, "Medium").otherwise("Low"))
    return scored.select(
        "customer_id", "prediction_method", ((p >= 0) & (p <= 100) & (F.col("risk_score") == p)).alias("within_bounds"),
        # Two decimals can round a probability up to the border of a level.
        ((F.col("risk_level") == level) | p.isin(25.0, 50.0, 75.0)).alias("level_fits"),
        (((p > 50) == (F.col("churn_prediction") == "Churn")) | (p == 50)).alias("prediction_fits"))


def _scoring_sql(method):
    return with_views(f"SELECT customer_id, '{method}' AS prediction_method, true AS within_bounds, true AS level_fits, true AS prediction_fits FROM customer_360")


@query("i10_score_customers_adaptive", _scoring_sql(fixed.MODE_ADAPTIVE))
def i10_score_customers_adaptive(spark, sf):
    return _scoring_facts(scoring.predict_customers(training_customers(spark, sf), clean=False))


@query("i10_score_customers_saved_model", _scoring_sql(fixed.MODE_SAVED))
def i10_score_customers_saved_model(spark, sf):
    d = training_customers(spark, sf)
    model, _ = training.run_training(d, "customer_id", {"Decision Tree": models.decision_tree}, cross_validation=False)
    return _scoring_facts(scoring.predict_customers(d, model=model, clean=False))


ALTERNATIVE = """
a AS (SELECT customer_id, recency_months * 30 AS days_inactive, usage_events AS login_count, support_tickets,
        CAST(customer_key %% 4 AS BIGINT) AS late_payments, monthly_charges AS monthly_spend FROM customer_360),
ag AS (%s),
ar AS (SELECT u.customer_id, least(greatest(CAST(0.45 AS DOUBLE) + %s * CAST(0.25 AS DOUBLE) + %s * CAST(0.15 AS DOUBLE)
         + %s * CAST(0.15 AS DOUBLE) + %s * CAST(0.20 AS DOUBLE), CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE)) AS risk FROM a u CROSS JOIN ag s)""" % (
    stats(["days_inactive", "login_count", "support_tickets", "late_payments"], "a"), signal("days_inactive"),
    signal("login_count", True), signal("support_tickets"), signal("late_payments"))


@query("i10_score_customers_alternative", with_views(f"""
SELECT customer_id, CASE WHEN risk >= 0.5 THEN 'Churn' ELSE 'Retained' END AS churn_prediction,
       {r2('risk * CAST(100 AS DOUBLE)')} AS churn_probability, '{fixed.MODE_BEHAVIOR}' AS prediction_method FROM ar""", extra=ALTERNATIVE))
def i10_score_customers_alternative(spark, sf):
    """A table of another industry: days without activity are a signal, not a label."""
    d = stored(customer_360, spark, sf).select(
        "customer_id", (F.col("recency_months") * 30).alias("days_inactive"), F.col("usage_events").alias("login_count"), "support_tickets",
        F.pmod("customer_key", F.lit(4)).alias("late_payments"), F.col("monthly_charges").alias("monthly_spend"))
    return scoring.predict_customers(d, clean=False).select("customer_id", "churn_prediction", "churn_probability", "prediction_method")
