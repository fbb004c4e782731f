"""Set-based PySpark operators for time-stamped panels of instruments."""
