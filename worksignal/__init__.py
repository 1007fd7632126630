"""Work-signal analytics on Spark: mail, calendar, notes and tasks of many tenants as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
