"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions and classes with their code, so executors need no copy of it. Objects of
# its classes travel in closures, never in explicit broadcasts, which pickle classes by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
