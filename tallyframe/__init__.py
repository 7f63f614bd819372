"""tallyframe: Spark-native reconciliation, data quality and training-data operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
