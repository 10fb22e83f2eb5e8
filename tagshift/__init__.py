"""Background modelling on event tables, written as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run in Python workers travel with the job, so that the package does not
# have to be installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
