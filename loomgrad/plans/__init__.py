"""Composed jobs: pipelines, cross-validation and the registered queries."""
