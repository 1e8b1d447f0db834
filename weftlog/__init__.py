"""Session-graph log analytics as Spark DataFrame operators."""
