"""Core subpackage: sources."""
