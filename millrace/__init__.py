"""Table-building library on PySpark: CSV / workbook / JDBC sources, SQL transforms,
dependency-ordered runs with result reuse, paged JSON-safe previews and CSV export."""

import sys

from pyspark import cloudpickle

from millrace.session import build_session, tune, workspace

# Functions that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "tune", "workspace"]
