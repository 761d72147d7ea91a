"""Operators of a training-data pipeline. Nothing outside this package and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, with the data they hold, so that the
# executors need no copy of it; Spark broadcasts the large ones.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
