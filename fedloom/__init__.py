"""Tabular preparation and federated-learning analytics on Spark."""
