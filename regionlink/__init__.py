"""Reconcile messy tables with named regions, on Spark."""
