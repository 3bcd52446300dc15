"""Operators over the tables of a keyspace."""
