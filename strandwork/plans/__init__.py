"""Runs of several stages, their records, and the command line."""
