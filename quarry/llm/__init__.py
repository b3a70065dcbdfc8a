"""Operators for preparing training data. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: what runs there is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
