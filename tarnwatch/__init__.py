"""tarnwatch: point-in-time analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
