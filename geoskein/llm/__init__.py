"""Operators on texts and large match sets for training-data pipelines. Nothing else in the library imports this package."""
