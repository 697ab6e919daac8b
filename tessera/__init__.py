"""Tessera: retrieval-QA analytics over document corpora as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
