"""Tessella: byte-pair-encoding analytics and language-model data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package on their path: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
