"""Schemas and column expressions that the operators share."""
