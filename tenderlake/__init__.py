"""Notice extraction and upkeep as Spark jobs over tables of fetched pages."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What a task needs of this package travels with it, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
