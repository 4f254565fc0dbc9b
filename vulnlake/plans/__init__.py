"""Whole jobs: analysis, enrichment, comparison of analyzers, evaluation."""
