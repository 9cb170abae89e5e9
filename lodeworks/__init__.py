"""lodeworks: a PySpark-native engine for typed tables, item sets, text search and entity resolution."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
