"""routewatch: BGP routing-update analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
