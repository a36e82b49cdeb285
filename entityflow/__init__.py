"""entityflow: entity matching, price-book valuation and the jobs around them, on PySpark."""

import sys

from pyspark import cloudpickle

from entityflow.params import Params

# Functions that run inside tasks travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
