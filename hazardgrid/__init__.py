"""Crash-network screening as Spark DataFrame operators."""
