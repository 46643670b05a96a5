"""Operators for preparing training text. Nothing outside this subpackage imports it.

The functions that run in Python workers are pickled by value, so executors need no copy of the package.
"""

import pyspark.cloudpickle as _pickle

import quillspark as _package

_pickle.register_pickle_by_value(_package)
