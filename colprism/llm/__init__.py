"""Operators for training data at scale.

What they run in Python tasks is sent to the executors by value, so a cluster needs
numpy, pyarrow and xxhash on its executors, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
