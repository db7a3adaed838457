"""panelcast — panel time-series preparation and vector-autoregression analytics on Spark.

Every operator takes and returns Spark DataFrames keyed by a series column, so one job
handles any number of series; Python/numpy only runs inside Arrow-batched tasks for the
small per-series matrix algebra.
"""

import sys

from pyspark import cloudpickle

from panelcast.spec import VarSpec, Det

# Task functions travel to the executors by value: these need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["VarSpec", "Det"]
