"""Spark-native preparation, search and audit of an evidence corpus."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
