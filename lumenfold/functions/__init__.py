"""Part of lumenfold; see the README for the map of modules."""
