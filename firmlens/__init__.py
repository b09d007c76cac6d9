"""Firm-by-year panel analytics expressed as Spark DataFrame programs."""
