"""Whole queries: from tables to results."""
