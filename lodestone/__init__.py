"""Lodestone: page-audit analytics and training-data operators on Spark."""
