import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ebbtide.functions import fixed
from ebbtide.operators import features, metrics, models
from ebbtide.plans import scoring, training
from ebbtide.session import new_path
from ebbtide.sources import models as saved
from workload.ml_queries import training_customers


@pytest.fixture(scope="module")
def split(spark, sf):
    train, test, meta = features.prepare_training_data(training_customers(spark, sf), "customer_id")
    return training.materialize(train), training.materialize(test), meta


def test_split_is_exact_repeatable_and_disjoint(spark, sf, split):
    train, test, meta = split
    again = features.prepare_training_data(training_customers(spark, sf).repartition(7), "customer_id")[1]
    assert test.select(features.KEY).exceptAll(again.select(features.KEY)).isEmpty()
    assert train.join(test, features.KEY).isEmpty()
    for c, n in features.class_sizes(train.unionByName(test)).items():
        assert features.class_sizes(test)[c] == round(0.2 * n)
    assert sum(meta["class_distribution"].values()) == train.count() + test.count()


def test_target_and_identifier_are_no_features(split):
    assert not {"churn", "customer_id"} & set(split[2]["feature_columns"])


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "Yes")], "tenure int, churn string")
    with pytest.raises(ValueError):
        features.prepare_training_data(df)


def test_class_with_one_row_is_split_without_strata(spark):
    df = spark.range(30).select("id", (F.col("id") == 3).cast("int").alias(features.LABEL))
    train, test = features.stratified_split(df, ["id"])
    assert (train.count(), test.count()) == (24, 6)


def test_unseen_category_becomes_zeros(spark, split):
    train, _, meta = split
    prep = features.fit_preprocessor(train, meta)
    odd = train.limit(1).withColumn("contract", F.lit("Ten years"))
    names = features.feature_names(prep, meta)
    vector = prep.transform(odd).first()["features"].toArray()
    assert len(names) == len(vector)
    assert not any(vector[i] for i, n in enumerate(names) if n.startswith("contract_"))


def test_quotes_in_fill_values(spark):
    df = spark.createDataFrame([("it's \\ odd", 1.0, i % 2) for i in range(30)] + [(None, None, 1)],
                               f"t string, x double, {features.LABEL} int")
    prep = features.fit_preprocessor(df, {"numeric_features": ["x"], "categorical_features": ["t"]})
    assert prep.transform(df).where("__c_0 = 'it\\'s \\\\ odd'").count() == 31


def test_training_comparison(spark, split):
    train, test, meta = split

    def broken(n):
        raise RuntimeError("does not fit")
    light = {"Logistic Regression": models.logistic_regression, "Decision Tree": models.decision_tree,
             "Boost": lambda n: models.gradient_boosting(n, rounds=3), "Broken": broken}
    results, fitted = training.train_models(train, test, meta, light)
    rows = {r["model"]: r for r in results.collect()}
    assert rows["Broken"]["status"].startswith("Failed") and set(fitted) == set(light) - {"Broken"}
    assert rows["Logistic Regression"]["roc_auc"] > 0.5 and 0 < rows["Logistic Regression"]["cv_f1_mean"] <= 1
    best = metrics.select_best(results).first()["model"]
    assert rows[best]["f1_score"] == max(r["f1_score"] for r in rows.values() if r["status"] == "Success")


def test_auc_equals_evaluator(spark, split):
    train, test, meta = split
    prep, matrix, _ = training.prepared(train, meta)
    out = models.decision_tree(1).fit(matrix).transform(prep.transform(test))
    want = BinaryClassificationEvaluator(rawPredictionCol="__vector", labelCol=features.LABEL, numBins=0).evaluate(out)
    scored = out.select(F.col(features.LABEL).alias("label"), models.churn_probability(out).alias("score"))
    for per_bucket in (2, 1_000_000):
        assert metrics.roc_auc(scored, rows_per_bucket=per_bucket).first()["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_zero(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.0


def test_adaptive_model_and_saving(spark, sf):
    d = training_customers(spark, sf)
    model = training.train_adaptive(d, "churn", trees=10)
    assert "churn" not in model.metadata["feature_columns"] and "customer_id" not in model.metadata["feature_columns"]
    assert model.metadata["roc_auc"] > 0.5
    again = saved.load_model(spark, saved.save_model(model, new_path(spark, "model")))
    assert again.metadata == model.metadata
    a, b = (m.predict(d).select("customer_id", "__probability") for m in (model, again))
    assert a.exceptAll(b).isEmpty()
    scored = scoring.predict_customers(d, model=again, clean=False)
    assert scored.select("prediction_method").distinct().first()[0] == fixed.MODE_SAVED
    assert scored.count() == d.count()


def test_too_few_rows_give_no_model(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No") for i in range(10)], "tenure int, churn string")
    assert training.train_adaptive(df, "churn") is None
    got = scoring.predict_customers(df, clean=False)
    assert got.select("prediction_method").distinct().first()[0] == fixed.MODE_BEHAVIOR
