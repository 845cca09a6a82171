"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
