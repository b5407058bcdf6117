"""Frame-keyed tracking analytics on Spark."""
