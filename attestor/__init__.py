"""Evidence retrieval and decision tables on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Kernels that run in Python workers travel with the job, so a cluster needs no installed copy.
register_pickle_by_value(sys.modules[__name__])
