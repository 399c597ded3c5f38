"""Tessera: n-d array analytics expressed as Spark plans."""
