"""fieldlake: a Spark-native lake for field-sensor text data.

Growing instrument files are tailed into Bronze, consolidated into Silver and
browsed together with human review flags and corrections.  Every operator takes
and returns DataFrames (or Columns) and stays lazy unless its name says it writes.
"""

from fieldlake.session import configure, create_session

__all__ = ["configure", "create_session"]
__version__ = "0.1.0"
