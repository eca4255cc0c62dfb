"""Readers and writers of analysed text and of rule and lexicon files."""
