"""Logical plans: from tables to lanes and blocks."""
