"""Operators for training data: each in a module of its own, registered queries in `queries`."""
