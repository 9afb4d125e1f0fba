"""Labelled-text analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
