"""Operators for training-data pipelines: deduplication, extraction, scoring, tokens and packing."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
