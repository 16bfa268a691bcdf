"""Candidate classifiers and the trained-model wrapper."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.functions.columns import logistic
from ebbtide.operators.boosting import Boosting, Rules
from ebbtide.operators.features import LABEL, SEED
from ebbtide.operators.forest import Forest
from ebbtide.operators.roles import has_features

COMMON = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": "__prediction"}
# Tree training keeps node statistics in memory and drops its long history at checkpoints.
TREES = {"maxMemoryInMB": 1024, "cacheNodeIds": False}


def logistic_regression(n, balanced=True, max_iter=2000):
    """L2 with C = 1 on scaled features: the penalty per weighted row is 1 / sum of weights, and
    balanced weights sum to the number of rows."""
    return _named(LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False,
                              tol=1e-6, **_weights(balanced), **COMMON))


def _named(estimator):
    return estimator.setRawPredictionCol("__raw").setProbabilityCol("__vector")


def _weights(balanced):
    return {"weightCol": "__weight"} if balanced else {}


def decision_tree(n, max_depth=8):
    return _named(DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=5, seed=SEED,
                                         **TREES, **_weights(True), **COMMON))


def random_forest(n, trees=300, max_depth=12, min_split=5):
    """Every tree sees a bag of the rows; the best of all thresholds of a few random features."""
    return Forest(trees, max_depth, min_leaf=2, min_split=min_split)


def extra_trees(n, trees=300, max_depth=12):
    """Extremely randomized trees: all rows, a random threshold for each of a few random features."""
    return Forest(trees, max_depth, min_leaf=2, min_split=5, bootstrap=False, random_thresholds=True)


def gradient_boosting(n, rounds=200):
    """Trees of depth 3 on gradients, leaves by one Newton step."""
    return Boosting(rounds, Rules(rate=0.05, max_leaves=8, max_depth=3, min_leaf=3, min_split=5, l2=0.0, criterion="friedman"))


def histogram_boosting(n, rounds=200):
    """Second-order trees of at most 15 leaves, grown best first, with an L2 term of 1."""
    return Boosting(rounds, Rules(rate=0.05, max_leaves=15, min_leaf=10, l2=1.0))


# fixed values: display names of the candidates
CANDIDATES = {
    "Logistic Regression": logistic_regression, "Decision Tree": decision_tree,
    "Random Forest": random_forest, "Extra Trees": extra_trees,
    "Gradient Boosting": gradient_boosting, "HistGradient Boosting": histogram_boosting,
}


def churn_probability(df):
    """P(class 1); a model that only gives a raw score is squashed."""
    if "__vector" in df.columns:
        return vector_to_array("__vector")[1]
    return logistic(vector_to_array("__raw")[1])


@dataclass
class TrainedModel:
    """Preprocessing and classifier in one pipeline, with the facts needed to use it."""
    pipeline: PipelineModel
    name: str
    metadata: dict
    spark: object

    def compatible(self, df):
        return has_features(df.columns, self.metadata.get("feature_columns"))

    def predict(self, df):
        """Input columns plus __probability and __prediction."""
        out = self.pipeline.transform(df)
        return out.select(*df.columns, churn_probability(out).alias("__probability"),
                          F.col("__prediction").cast("int").alias("__prediction"))
