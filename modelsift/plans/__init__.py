"""Compositions of operators: a scan over all models, measures, reports and publishing."""
