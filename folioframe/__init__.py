"""Analytics over document corpora and sheet-like tables, written as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
