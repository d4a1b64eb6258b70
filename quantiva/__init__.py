"""quantiva: exploratory statistics as Spark DataFrame jobs.

Every operator takes a DataFrame and returns a DataFrame.  Python code that
runs inside tasks (pandas UDF kernels) is pickled by value, so executors
need only PySpark, numpy and pandas -- not this package.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
