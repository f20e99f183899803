"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run inside Python tasks are pickled by value, so executors need only the public libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
