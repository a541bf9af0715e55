"""Tramline: transport-network planning analytics on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the library's functions by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
