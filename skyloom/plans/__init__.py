"""Whole jobs: gazetteer build, input adapters and the registered queries."""
