"""PySpark-native analytics over weighted, directed dependency graphs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers carry their code, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
