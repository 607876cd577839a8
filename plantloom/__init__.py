"""Sensor-table analytics on PySpark: every operator takes and returns DataFrames."""

__version__ = "0.1.0"
