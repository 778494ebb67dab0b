"""Numeracy data work as Spark jobs: problem tables, number text, token corpora, answer scoring."""
import sys

from pyspark import cloudpickle

# Ship the functions used inside tasks with the tasks, so that executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
