"""Operators put together: preparation, profile, training and evaluation."""
