"""Vellum: a Spark-native engine for scoring, auditing and curating wide feature tables."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
