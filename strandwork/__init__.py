"""Sequence-to-reference analytics as DataFrame operators on Apache Spark."""
