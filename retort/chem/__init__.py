"""Molecule kernel in plain Python: parsing, perception, canonical writing, matching, hashing, standardisation."""
