"""Similarity search over dense vectors, dynamic index maintenance and event-stream analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
