"""Comparative-genomics analytics as table-in / table-out Spark operators."""
