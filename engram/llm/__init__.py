"""Operators for preparing training data: one module for each, queries in ``queries``."""
