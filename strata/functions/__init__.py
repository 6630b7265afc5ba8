"""Scalar functions and sketches over changelogs."""
