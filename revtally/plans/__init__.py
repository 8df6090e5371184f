"""Whole queries: the statistics entry point and the reports."""
