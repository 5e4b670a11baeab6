"""Registered queries: callables over (session, data folder) and the SQL that gives the same rows."""
