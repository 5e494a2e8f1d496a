"""Training-data operators. Nothing outside this folder imports it.

Functions that run inside Python workers are pickled by value, so executors
need the libraries of the image but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
