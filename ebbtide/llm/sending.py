"""Models for the workers. Plain broadcasts carry only objects whose module the workers can import;
here the classes travel with the values."""

import pickle

from pyspark import cloudpickle


def broadcast(spark, value):
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)
