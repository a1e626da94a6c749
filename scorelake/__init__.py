"""Scoring, summarising and preparing model-evaluation logs as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so workers need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
