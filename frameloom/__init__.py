"""Media curation and entitlement analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
