"""A corpus study engine on Spark."""
