"""Orchestration analytics on Spark: runs, task instances, logs, values and schedules as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
