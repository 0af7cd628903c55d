"""Operators for building training data for language models from very large document tables."""

from pyspark import cloudpickle as _cloudpickle

import tessella as _tessella

# Functions that run in Python workers travel by value, so that executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_tessella)
