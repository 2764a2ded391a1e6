"""roadloom: spatial road-network analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
