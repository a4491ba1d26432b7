"""Customer analytics as ordinary Spark DataFrame and Structured Streaming jobs."""
