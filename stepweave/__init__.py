"""Stepweave: a Spark-native engine for step-by-step trajectory data and the records around it."""

from stepweave.session import get_spark, table

__all__ = ["get_spark", "table"]
__version__ = "0.1.0"
