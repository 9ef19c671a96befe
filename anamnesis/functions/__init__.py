"""Subpackage of the anamnesis engine."""
