"""Operators put together: routes, the inventory and its oracle."""
