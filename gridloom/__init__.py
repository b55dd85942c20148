"""Spark-native analytics over gridded, multi-variable time series."""

import sys

from pyspark import cloudpickle

# functions that run in Spark's Python workers are sent by value, so that executors
# need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
