"""Operators for preparing training data: one module each, with its query and, where SQL can express it, its SQL."""
