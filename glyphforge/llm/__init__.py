"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

The functions that run on executors travel with the job by value, so that the
executors need no copy of the library on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
