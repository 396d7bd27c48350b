"""Operators: functions from DataFrames to DataFrames, with the names of key and value columns as parameters.

Functions that run on executors are pickled by value, so a cluster needs no copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
