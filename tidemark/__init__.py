"""Sensor-series repair on Spark: find frozen readings, reconstruct them, score the result."""
