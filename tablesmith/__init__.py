"""tablesmith — Spark-native tabular profiling, preparation and modelling.

Every statistic is learned by a small, fixed number of DataFrame aggregate jobs and applied back as plain column
expressions, so the same code runs on a laptop-sized table and on a cluster-sized one.
"""

__version__ = "0.1.0"
