"""spendlens: usage-and-cost analytics over captured model-API exchanges, on Spark."""
