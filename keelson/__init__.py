"""Data evolution and integrity toolkit for PySpark."""

import sys

from pyspark import cloudpickle

from keelson.session import get_session
from keelson.specs import Check, Column, ForeignKey, TableSpec, Unique

__all__ = ["Check", "Column", "ForeignKey", "TableSpec", "Unique", "get_session"]

# Functions sent to Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
