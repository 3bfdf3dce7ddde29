"""Pipelines composed from the operators, generic over table and column names."""
