"""Contract-snapshot, version-history and dependency analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# the few functions that run on Python workers travel with their code, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
