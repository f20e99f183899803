"""Spark-first analytics over transactions, listings, events and text corpora.

Functions that run inside Python tasks are pickled by value, so executors need only the public libraries.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
