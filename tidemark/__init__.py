"""Spark-native analytics over recorded signal tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
