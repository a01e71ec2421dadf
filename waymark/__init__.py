"""Address linkage and corpus preparation on Spark."""
