"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Functions that run on
executors travel by value, so the workers need not find the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
