"""Reads, writes, SQL and coroutines of entities."""
