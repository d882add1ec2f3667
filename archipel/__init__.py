"""Archipel: batch preparation, retrieval and evaluation of a text archive as Spark plans.

Functions that run inside Python workers are pickled by value, so executors need only PySpark,
pyarrow, pandas and numpy, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
