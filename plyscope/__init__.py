"""Game-tree analytics on Spark."""
