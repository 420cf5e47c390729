"""Set-wise text analytics on Spark."""
