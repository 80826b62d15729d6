"""lexiquarry: document preparation and retrieval as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from .session import build_session, work_path

# Functions used inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "work_path"]
