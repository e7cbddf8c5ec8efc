"""Operators for preparing training data: one module per operator; nothing else in the package imports them."""
