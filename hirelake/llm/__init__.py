"""Operators for preparing language-model training data, each a function from DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the job, so no worker needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
