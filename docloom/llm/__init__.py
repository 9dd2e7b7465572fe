"""Operators for preparing training data.

Python workers get this subpackage's functions by value, so a job needs nothing installed on the executors
but the libraries it imports.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
