"""Whole comparisons: all modules, the overall score, reports."""
