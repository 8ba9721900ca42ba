"""Repository analytics on Spark."""
