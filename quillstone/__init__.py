"""Quillstone: retrieval, text analytics and document processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: what they run of it travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
