"""Relational operators: joins, aggregates, rankings and gates over evidence tables."""
