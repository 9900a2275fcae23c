"""Need-based allocation analytics on Spark."""
