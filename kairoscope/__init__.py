"""Kairoscope: a PySpark-native engine for temporally grounded, evidence-graded knowledge graphs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that no machine needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
