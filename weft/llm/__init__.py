"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
