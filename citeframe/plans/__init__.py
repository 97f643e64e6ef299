"""Whole jobs: which operators run, what is staged, what comes out."""
