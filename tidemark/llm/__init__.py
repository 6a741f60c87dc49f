"""Operators for training-data pipelines: texts, pages, vectors and mixtures. Nothing outside imports this package."""
