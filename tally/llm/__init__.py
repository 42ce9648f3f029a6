"""Operators for large training-data pipelines.

Functions that run in Python workers are shipped by value, so executors do
not need this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
