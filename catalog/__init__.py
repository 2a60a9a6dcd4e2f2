"""Registered queries: each operator run over the given tables, with the SQL that checks it."""
