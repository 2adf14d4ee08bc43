"""Operators for building training corpora; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
