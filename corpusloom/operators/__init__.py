"""Relational operators over the tables of an index; see each module."""
