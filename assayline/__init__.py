"""Spark-native evaluation and release gating of generated text."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors do not need this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
