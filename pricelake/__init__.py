"""Grocery price intelligence as Spark jobs.

Functions that run in Python workers are sent with the job, so the cluster need not have this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
