"""Spark-native analytics for picture-forensics manifests, scores, masks and patch embeddings."""

import sys

from pyspark import cloudpickle

from patchmill.errors import ConfigError, DataError, EvalError
from patchmill.session import get_spark

__all__ = ["ConfigError", "DataError", "EvalError", "get_spark"]

# Kernels travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
