"""Spark-native analytics over timestamped multimodal observations."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
