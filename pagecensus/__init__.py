"""Website evidence at scale: page captures in, inventories, selections, measurements, findings out."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
