"""A PySpark-native engine for post-training data and its evaluation.

Functions that run on executors travel by value, so that workers need not find
the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
