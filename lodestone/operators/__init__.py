"""Relational operators over vectors, graphs and event logs."""
