"""Core subpackage: operators."""
