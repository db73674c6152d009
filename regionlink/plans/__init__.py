"""Whole runs: maps, the command line, and the queries that are checked."""
