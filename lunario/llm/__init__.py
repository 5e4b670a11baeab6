"""Corpus operators: tokenization, source mixing, template residue, percentiles. Nothing outside imports this package."""
