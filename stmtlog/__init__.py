"""Statement-log integrity mining on Spark."""
