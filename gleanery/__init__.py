"""Gleanery: a PySpark-native engine for annotation, evaluation and record data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the package's functions travel to the workers by value, so that these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
