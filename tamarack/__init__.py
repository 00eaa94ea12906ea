"""A PySpark-native engine for concept retrieval, graph and evaluation analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
