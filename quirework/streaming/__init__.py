"""Core subpackage: streaming."""
