"""Arrivals: file streams, stage sentinels, incremental fills."""
