"""Operators for large training-data pipelines. Nothing else in tidemark imports this subpackage."""
