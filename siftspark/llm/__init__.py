"""Operators for preparing training data.

Functions that run in Python workers are pickled by value, so executors need
nothing but Python, numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
