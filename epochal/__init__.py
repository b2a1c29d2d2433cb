"""Analytics on multichannel recordings, as Spark DataFrame operations."""
