"""See the package README."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
