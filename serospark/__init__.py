"""Antigenic-distance analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from serospark.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
