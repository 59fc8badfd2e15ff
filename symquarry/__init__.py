"""Symbol search and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value: they need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
