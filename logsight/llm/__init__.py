"""Operators of a training-data pipeline, and their registered queries.

Functions of this subpackage run inside executor tasks. They are pickled by
value, so an executor needs numpy and pyarrow but no copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
