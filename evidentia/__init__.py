"""Evidence reconciliation and corpus processing on Spark."""
