"""Sensitive-data classification, protection and catalog work on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Batch functions carry their own code to the executors, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
