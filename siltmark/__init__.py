"""siltmark: feature-selection experiments, audits and severity indices as Spark jobs.

Every operator takes DataFrames and returns DataFrames; a repeat, an arm or a
parameter is a column of one table, never a driver loop over separate jobs.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside tasks travel by value, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
