"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Workers get these functions with the task, so the package needs no installation on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
