"""Bulk web-site profiling as Spark DataFrame operators."""
