"""Operators on sentences, phrases, mentions and frames."""
