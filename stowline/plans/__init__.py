"""Derivation, sequencing, simulation and checking of file-move plans."""
