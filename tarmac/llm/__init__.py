"""Operators for large training-data pipelines, each over whole tables.

Functions and classes of this package reach the Python workers by value, and broadcasts
hold plain arrays only, so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
