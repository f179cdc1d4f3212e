"""siltstone: a PySpark-native analytics engine for code-review data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with their code, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
