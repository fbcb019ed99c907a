"""corpuscope: a PySpark-native analytics engine for code and document corpora."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
