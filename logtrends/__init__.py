"""Log-anomaly analysis and keyword trends as plain Spark DataFrame programs."""
