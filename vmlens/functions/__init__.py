"""Column functions. Invalid input gives null; strict() turns that into an error.

Functions that run on executors are pickled by value, so a cluster needs no copy of the package there.
"""

import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(value: Column, given: Column, message: str) -> Column:
    """`value`, or an error that names the input where it's null though the input isn't."""
    return F.when(value.isNull() & given.isNotNull(), F.raise_error(F.concat(F.lit(message + ": "), given.cast("string")))).otherwise(value)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
