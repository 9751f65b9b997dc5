"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
