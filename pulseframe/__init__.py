"""Signal, event-stream and corpus analytics as plain Spark DataFrame operators."""
