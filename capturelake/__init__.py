"""Capture analytics on PySpark: probe, resolve, plan and cut long sampled captures."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value: a cluster needs
# no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
