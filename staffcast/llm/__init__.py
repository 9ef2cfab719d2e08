"""Operators for training data: archives, cleaning, scoring, search, mixing and sharding.

Functions of this package that run in tasks are sent with the tasks, so the executors
need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
