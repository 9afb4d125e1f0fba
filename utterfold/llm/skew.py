"""Joins that stay even when one key holds a large part of all rows."""

from ..operators.lookup import SHARES, count_keys, hot_keys, salted_join

__all__ = ["SHARES", "count_keys", "hot_keys", "salted_join"]
