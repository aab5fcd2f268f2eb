"""Document-quality analytics on Spark."""

import sys

from pyspark.cloudpickle import cloudpickle

# The package's Python functions travel to the executors with the tasks: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
