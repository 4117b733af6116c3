"""Data quality for object-centric event logs on Apache Spark."""
