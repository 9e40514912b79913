"""DataFrame operators for keyed, gappy hourly sensor series on Spark."""
