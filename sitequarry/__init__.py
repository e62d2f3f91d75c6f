"""Site-archive analytics on Spark: every step is a DataFrame in, a DataFrame out."""
