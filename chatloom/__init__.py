"""Spark-native preparation of multimodal chat data."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
