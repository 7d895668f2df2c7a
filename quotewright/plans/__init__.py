"""Registered queries: adapter views, Spark side and SQL side."""
