"""Operators for training corpora. Nothing else in logloom imports this subpackage."""
