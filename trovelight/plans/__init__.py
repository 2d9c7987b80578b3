"""Whole queries, and the join strategies they share."""
