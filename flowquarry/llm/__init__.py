"""Operators for training-data pipelines. Nothing else in flowquarry imports this subpackage."""
