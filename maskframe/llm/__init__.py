"""Training-data operators: one module per operator, plus ``catalog`` with their queries and SQL."""
