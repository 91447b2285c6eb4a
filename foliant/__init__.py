"""foliant: document analytics on Spark."""
