"""Saving and loading trained pipelines: a Spark ML directory and its metadata as JSON."""

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel

from ebbtide.operators.models import TrainedModel

VERSION = 1


def save_model(model, path):
    spark = model.spark
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    text = json.dumps({"name": model.name, "metadata": model.metadata, "version": VERSION})
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_model(spark, path):
    """The saved model, or None where there is none."""
    try:
        head = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return TrainedModel(PipelineModel.load(f"{path}/pipeline"), head["name"], head["metadata"], spark)


def save_preprocessor(pipeline, metadata, path, spark):
    return save_model(TrainedModel(pipeline, "preprocessor", metadata, spark), path)


def load_preprocessor(spark, path):
    found = load_model(spark, path)
    if found is None:
        raise FileNotFoundError(f"preprocessor not found: {path}")
    return found.pipeline
