"""Point-in-time analytics on Spark DataFrames.

Functions that run inside Python tasks are sent to the workers by value, so that a cluster needs no
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
