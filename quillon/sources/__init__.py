"""Readers of text, markup, JSON and XML into lines and tokens, and writers of corpora and results."""
