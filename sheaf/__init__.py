"""sheaf: typed delimited text on Spark."""
