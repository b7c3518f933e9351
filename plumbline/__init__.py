"""SQL review at corpus scale, as ordinary Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors with the plan, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
