"""Queries over the driver's tables, one module for each family of operators."""
