"""Compositions of operators: the plant ledger and the query catalogue."""
