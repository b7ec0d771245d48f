"""tracewell: Spark-native analytics over request/response latency evidence."""
