"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: what a task runs travels with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])
