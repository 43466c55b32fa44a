"""Whole pipelines, made of operators, and the registered queries."""
