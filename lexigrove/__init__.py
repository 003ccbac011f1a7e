"""lexigrove: text analytics and ranked retrieval over Spark DataFrames."""

from pyspark import cloudpickle
import sys

# Functions of this package travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
