"""Analytics for imbalanced and sparse data, written as Spark DataFrame jobs."""
