"""Behaviour-sequence analytics as Spark DataFrame operators."""
