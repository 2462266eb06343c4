"""siftspark: ingest, retrieval, ranking and state queries over document collections, on Spark.

Functions that run in Python workers are pickled by value, so executors need
nothing but Python, numpy, pandas and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
