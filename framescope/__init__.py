"""Telemetry and quality analytics over frame logs, written for Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Kernels travel to the workers with their code, so executors need no copy of this package and no common working directory.
register_pickle_by_value(sys.modules[__name__])
