"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions of these modules travel to the Python workers by value, so executors need no copy of them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
