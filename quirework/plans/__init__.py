"""Core subpackage: plans."""
