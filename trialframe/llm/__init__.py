"""Operators of a training-data pipeline. Nothing else of the library imports this folder."""

import sys

from pyspark import cloudpickle

# tasks get this folder's functions with the job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .queries import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
