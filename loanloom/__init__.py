"""Retail-lending data work as Spark jobs: checks, relational queries, client
features, feature tests, cleaning, models and loan decisions on DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so executors do not need
# this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
