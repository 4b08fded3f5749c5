"""Registered queries, their inputs, and the SQL that states the same answers."""
