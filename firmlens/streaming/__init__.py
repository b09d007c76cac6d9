"""Intentionally empty: the covered workload is batch only (no sources, watermarks or state)."""
