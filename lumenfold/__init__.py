"""lumenfold: a Spark-native engine for particle snapshots, imaging and level of detail.

Functions of this package travel to executors by value, so a cluster needs no copy of it on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
