"""Checks of the operators on the supplied tables: adapters, queries and their SQL twins."""
