"""plumbline: exploratory analysis, data preparation and tabular ML as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helpers used inside Python workers travel with the task, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
