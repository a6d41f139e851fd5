"""Inkwell: stylometry and corpus analytics as Spark DataFrame plans.

Functions of this package travel to Python workers by value, so executors need no installed copy.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
