"""Analytics for time-aligned data on Spark: uniform series, sorted events and half-open intervals."""
