"""Topic analytics over text corpora as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the small kernel functions with the task itself, so a job
# does not depend on the package being installed on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
