"""Whole plans: from files to an index, and from questions to answers."""
