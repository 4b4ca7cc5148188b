"""panelkit: panel time-series preparation, backtesting and evaluation on Spark.

Every operator takes DataFrames and returns a DataFrame.  Nothing here loops
over series on the driver: a panel is one long table
``(series_id, ts, y, covariates...)`` and each operator is a declarative plan.
"""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
