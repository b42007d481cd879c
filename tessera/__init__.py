"""Tessera: web-to-profile analytics as set-oriented PySpark jobs."""

__version__ = "0.1.0"

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run inside tasks travel with the task, so executors need no
# copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
