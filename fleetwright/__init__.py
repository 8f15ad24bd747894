"""Fleet operations analytics on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

from fleetwright.session import get_session

# Functions of this package travel to the executors with the job that uses them, so executors
# need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
