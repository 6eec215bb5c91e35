"""Corpus-preparation operators for training data (deduplication, mixing,
sharding, packing, classification), one module per operator.

Functions that run inside Python tasks are shipped by value, so executors
need only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
