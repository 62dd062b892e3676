"""Registered queries, each with the DuckDB SQL that gives the same rows where SQL can express it."""
