"""aerolith: Spark-native analytics over hourly environmental sensor readings.

Every operator is a plain function ``DataFrame -> DataFrame`` whose work runs on
executors; see ``README.md`` for the operator map.
"""

__version__ = "0.1.0"
