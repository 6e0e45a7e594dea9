"""Multi-step signal-cleaning outputs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions run by tasks travel with them, so that executors need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
