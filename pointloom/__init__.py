"""Space-filling sampling and diversity analytics on Spark."""
