"""Quire: document layout and text analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
