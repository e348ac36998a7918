"""Wide-model analytics on Spark."""
