"""Operators: transformers with fit, transform and report."""
