"""spendlens: transaction analytics on Spark."""
