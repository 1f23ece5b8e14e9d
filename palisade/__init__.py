"""Palisade: security-event analytics as PySpark DataFrame operations.

Every public operation is a plain function ``op(df, ...) -> DataFrame`` (or a
column expression), takes its reference time as an argument, and runs on a
table or, where it makes sense, on a stream.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
