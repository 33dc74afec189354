"""Composed jobs (batch processing, training, serving read models) and the
registry of named queries with their SQL twins."""
