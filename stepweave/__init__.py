"""Step-trajectory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the Python workers by value: nothing has to be installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
