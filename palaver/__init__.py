"""Chat-history export and analysis as Spark jobs.

Every operator takes and returns DataFrames over the canonical tables of
:mod:`palaver.schema`; nothing runs before a sink or the caller's action.
"""

__version__ = "0.1.0"
