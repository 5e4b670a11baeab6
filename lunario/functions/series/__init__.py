"""Calculators of a time-ordered series in three tiers: SQL aggregates, array expressions, numpy."""
