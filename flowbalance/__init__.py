"""Composition accounting, reconciliation and market analytics on Spark."""
