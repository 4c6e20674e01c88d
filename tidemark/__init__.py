"""Event-time analytics on Spark."""
