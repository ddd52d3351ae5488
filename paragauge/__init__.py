"""Parallel-corpus preparation and translation scoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
