"""Community interaction analytics on Spark."""
